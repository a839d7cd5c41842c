"""Main text of HTML pages: parser events to lines, text-to-tag ratios, Gaussian smoothing, threshold clustering.

1. The standard library's streaming parser turns a page into lines (one a block of text), each with its characters, its tags, its linked
   characters and the container it stands in.
2. The ratio of unlinked characters to tags is smoothed over neighbouring lines; lines above a threshold between the two clusters of
   ratios are content. Characters of what the page itself calls no article (below) count as linked ones do: as no text.
3. Content characters are added up along the container tree, and the region is found from the top: a container gives way to
   the one inside it that holds nearly all of its content, unless it has content lines of its own.
4. Of the region, lines go that stand before or after all content in a container without content, link lists without content (those between content lines of the region itself stay), what follows a heading
   such as "3 comments" in its container, and a copyright line at the end.

What a page says about itself is evidence on top: forms, scripts and hidden elements are never read, an ``article`` counts more in step 2 and is not
trimmed in step 4, and the text of ``nav``, ``footer``, ``aside``, of the page's header and of containers whose class, id or role consists of boilerplate words only
counts nothing in step 2 (unless these hold the content of the page), so that it falls below the threshold. Parsing and choosing take time in proportion to the page, however deep it nests.

Defined cases: null and empty html give an empty text; text outside any element counts; unclosed elements end with their
parent; unknown declarations and marked sections are comments; white space (that of ``str.split``, no-break space too) becomes one space; every row is
judged by itself, so repeated rows and null ids keep their rows; an empty table gives no rows; columns other than id, url and html are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.html import LenientParser

#: Elements whose text is never shown, or is no text of an article.
SKIP = frozenset("script style noscript template head title svg iframe object canvas audio video map select option button textarea input form menu dialog datalist fieldset".split())
#: Elements whose text counts nothing.
ASIDE = frozenset("nav footer aside".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that start and end a line.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that are containers of lines.
REGION = frozenset("html body main article section div td center table ul ol dl header".split())
#: Containers that step 4 trims; lists and tables are part of the text around them.
PLAIN = frozenset("html body section div td center header".split())
LISTS = frozenset("ul ol dl table div section".split())
ITEMS = frozenset(("ul", "ol", "dl"))
NAMED = frozenset(("article", "main"))
#: An open element of these is closed by the start of a key element.
CLOSES = {
    **{x: ("p",) for x in "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()},
    "li": ("li", "p"),
    "dd": ("dd", "dt", "p"),
    "dt": ("dd", "dt", "p"),
    "td": ("td", "th", "p"),
    "th": ("td", "th", "p"),
    "tr": ("tr", "td", "th", "p"),
    "option": ("option",),
}
#: Elements that such implied ends do not reach through.
WALLS = frozenset("html body main article section div aside nav footer header form ul ol dl table td th blockquote".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

#: Words for what is no article. A class, id or role is a hint if it has one of them and otherwise words of layout only.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead header topbar toolbar"
    " comment comments commentlist respond replies reply disqus cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login"
    " share sharing social related recommended recommendations trending popular widget widgets pagination pager search complementary contentinfo disclaimer copyright tags".split()
)
LAYOUT = frozenset(
    "site page main top bottom left right side inner outer upper lower wrap wrapper container holder box bar area block section list group item items link links primary secondary global row col column"
    " post posts article articles entry content body text thread author button buttons icon icons media form slot unit results user users reader readers policy message the of and".split()
)
#: Last words that settle it whatever stands before them.
FINAL = frozenset("sidebar comments navbar breadcrumb breadcrumbs disqus".split())
#: Headings of reader comments, and lines that end a page.
_COMMENT_HEAD = re.compile(r"(?:\d+|no|all|leave an?|post an?|reader)?\s*(?:reader )?(?:comments?|repl(?:y|ies)|responses|kommentare?|commentaires?|comentarios?)(?:\s*\(?\d+\)?)?:?", re.I)
_COPYRIGHT = re.compile(r"(?:©|\(c\)|copyright\b)(?=.*\b(?:19|20)\d\d\b|.*\brights reserved\b).{0,200}", re.I)
_REPLIES = frozenset("comment comments commentlist respond replies reply disqus".split())
_HEADER = frozenset(("header", "masthead", "banner"))
#: Words of the article's own header.
_OWN = frozenset("post posts article articles entry content author".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
NOTHING, BOILER, COMMENTS, HEADER, BESIDE = range(5)

SIGMA = 1.0
#: Share of its content at which a container gives way to one inside it.
DOMINANT = 0.98
#: Containers of one line each (adverts, credits) do not stand in the way of one of several lines with so much more text.
LOOSE = 0.5
#: How much more the text of an article or main element counts in the ratio.
FAVOUR = 3.0
#: Share of a page's content from which a hint is taken to be about the layout.
LAYOUT_SHARE = 0.9


def hint(value: str) -> int:
    """What one class, id or role says: nothing, boilerplate, reader comments or a header."""
    words = [w.lower() for w in _WORD.findall(value)]
    said = [w for w in words if w in BOILERPLATE]
    if not said or not (words[-1] in FINAL or all(w in BOILERPLATE or w in LAYOUT for w in words)):
        return NOTHING
    if _REPLIES.intersection(said):
        return COMMENTS
    if _HEADER.intersection(said):
        return NOTHING if _OWN.intersection(words) else HEADER
    return BOILER


#: Text, tags since the line before, linked characters, region, heading level (0: none), whether in a header.
Line = tuple[str, int, int, int, int, bool]


class _Lines(LenientParser):
    """Streams a page into lines and a tree of regions."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.kind = [""]  # of each region: its element, its parent, its hint, whether it is inside an article; region 0 is the page
        self.parent = [-1]
        self.hints = [NOTHING]
        self.named = [False]
        self.stack: list[tuple[str, bool, int, bool]] = []  # element, skipped, the region around it (-1: it is none itself), header
        self.region = 0
        self.open: list[Counter[str]] = [Counter()]  # open elements since each wall
        self.walls: Counter[str] = Counter()
        self.skipping = self.links = self.headers = 0
        self.levels: list[int] = []  # of the open headings
        self.text: list[str] = []
        self.tags = self.linked = 0

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.lines.append((text, self.tags, min(self.linked, len(text)), self.region, self.levels[-1] if self.levels else 0, self.headers > 0))
            self.text.clear()
        self.tags = self.linked = 0

    def _says(self, tag: str, attrs: list[tuple[str, str | None]]) -> tuple[bool, int]:
        """Whether the element is hidden, and its hint."""
        found = NOTHING
        for k, v in attrs:
            if k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and v and "display:none" in v.replace(" ", "").lower()):
                return tag not in ("html", "body"), NOTHING
            if v and k in ("class", "id", "role", "aria-label"):
                for x in (v.replace(" ", "-"),) if k == "aria-label" else v.split():
                    found = found or hint(x)
        if tag in ("html", "body", "main") or (tag == "article" and found != COMMENTS):
            found = NOTHING
        return False, found

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        block = tag in BLOCK
        for name in CLOSES.get(tag, ()):
            if self.open[-1][name]:
                self._close(name)
        if block:
            self.flush()
        elif tag == "br":
            self.text.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        # A button in a paragraph is a word of it.
        skip, said = (True, NOTHING) if tag in SKIP and not (tag == "button" and self.open[-1]["p"]) else self._says(tag, attrs)
        if tag in ASIDE:
            said = BESIDE
        header = tag == "header" or said == HEADER
        around = -1
        if tag in REGION or said:
            around, self.region = self.region, len(self.kind)
            self.kind.append(tag)
            self.parent.append(around)
            self.hints.append(HEADER if header else said)
            self.named.append(self.named[around] or (tag in NAMED and said != COMMENTS))
        self.stack.append((tag, skip, around, header))
        if tag in WALLS:
            self.walls[tag] += 1
            self.open.append(Counter())
        else:
            self.open[-1][tag] += 1
        self.skipping += skip
        self.links += tag == "a"
        self.headers += header
        if tag in HEADINGS:
            self.levels.append(int(tag[1]))

    handle_startendtag = handle_starttag

    def _close(self, name: str) -> None:
        """Close the innermost open ``name`` and all inside it."""
        while True:
            tag, skip, around, header = self.stack[-1]
            if tag in BLOCK:
                self.flush()
            self.stack.pop()
            if tag in WALLS:
                self.walls[tag] -= 1
                self.open.pop()
            else:
                self.open[-1][tag] -= 1
            self.skipping -= skip
            self.links -= tag == "a"
            self.headers -= header
            if tag in HEADINGS:
                self.levels.pop()
            if around >= 0:
                self.region = around
            if tag == name:
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if (self.walls if tag in WALLS else self.open[-1])[tag]:
            self._close(tag)

    def handle_data(self, data: str) -> None:
        if self.skipping:
            return
        self.text.append(data)
        if self.links:
            self.linked += len(data)


def smooth(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; at the edges the kernel is cut and weighed again."""
    radius = max(1, math.ceil(2 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    cut = slice(radius, radius + len(x))
    return np.convolve(x, kernel)[cut] / np.convolve(np.ones(len(x)), kernel)[cut]


def threshold(x: np.ndarray) -> float:
    """Midpoint of the two clusters (2-means) of the values."""
    lo, hi = float(x.min()), float(x.max())
    for _ in range(20):
        mid = (lo + hi) / 2
        below, above = x[x <= mid], x[x > mid]
        if not len(above) or not len(below):
            break
        new = float(below.mean()), float(above.mean())
        if new == (lo, hi):
            break
        lo, hi = new
    return (lo + hi) / 2


def _rolled(parent: list[int], own: np.ndarray) -> np.ndarray:
    """Sums over each region and all inside it; a region's number is larger than its parent's."""
    total = own.tolist()
    for r in range(len(parent) - 1, 0, -1):
        total[parent[r]] += total[r]
    return np.array(total)


def content_lines(lines: list[Line], named: np.ndarray, void: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Whether each line's smoothed text-to-tag ratio is in the upper cluster; ``named``: lines of an article get a higher one, and those of its
    header their own, as what is around them is of another kind; ``void``: lines whose text counts nothing, which are not smoothed over either."""
    free = np.array([len(x[0]) - x[2] for x in lines], float) * ~void
    ratio = np.log1p(free / np.array([1 + x[1] for x in lines], float))
    level = ratio.copy()
    if not void.all():
        level[~void] = smooth(ratio[~void], sigma)
    level = np.where([x[5] for x in lines], ratio, level) + named * ~void * math.log(FAVOUR)
    content = level > threshold(level)
    return content if content.any() else level >= level.max()


def void_lines(page: _Lines, lines: list[Line]) -> np.ndarray:
    """Lines of what the page calls no article. Hints of classes, ids and roles hold, unless all articles of the page stand inside what they mark, or it has no
    article and nearly all its text is there."""
    n_regions, parent = len(page.kind), page.parent
    at = np.array([x[3] for x in lines], int)
    beside = [False] * n_regions
    for r in range(1, n_regions):
        beside[r] = beside[parent[r]] or page.hints[r] == BESIDE
    aside = np.array(beside)[at] | np.array([x[5] and not page.named[x[3]] for x in lines])
    free = np.array([len(x[0]) - x[2] for x in lines], float) * ~aside
    text = _rolled(parent, np.bincount(at, weights=free, minlength=n_regions))
    articles = _rolled(parent, np.array([k in NAMED and h == NOTHING for k, h in zip(page.kind, page.hints, strict=True)], float))
    out = [False] * n_regions
    for r in range(1, n_regions):
        said = page.hints[r] if page.hints[r] in (BOILER, COMMENTS) else NOTHING
        layout = articles[r] == articles[0] if articles[0] else said == BOILER and text[r] >= LAYOUT_SHARE * text[0]
        out[r] = out[parent[r]] or (said != NOTHING and not layout)
    return aside | np.array(out)[at]


def comment_lines(page: _Lines, lines: list[Line], shown: np.ndarray) -> np.ndarray:
    """Lines from a heading of reader comments on, to the end of the container that it opens or to a heading as high; the first heading of a page is none."""
    found = np.zeros(len(lines), bool)
    inside = np.bincount([x[3] for x in lines], minlength=len(page.kind))
    inside = _rolled(page.parent, inside)
    seen, level, held = False, 0, frozenset()
    for i, x in enumerate(lines):
        if level and (not (r := x[3]) in held or 0 < x[4] <= level):
            level = 0
        if not level and seen and x[4] and _COMMENT_HEAD.fullmatch(x[0]):
            top = x[3]
            while top > 0 and inside[top] == 1:
                top = page.parent[top]
            held = {top}
            for r in range(top + 1, len(page.kind)):
                if page.parent[r] in held:
                    held.add(r)
            level = x[4]
        found[i] = level > 0
        seen = seen or bool(shown[i])
    return found


def main_text(html: str | None, sigma: float = SIGMA) -> str:
    """The article of a page, blocks joined by two newlines."""
    if not html:
        return ""
    page = _Lines()
    page.feed(html)
    page.close()
    page.flush()
    lines = page.lines
    if not lines:
        return ""
    void, in_article = void_lines(page, lines), np.array(page.named)
    if void.all():
        return ""
    content = content_lines(lines, in_article[[x[3] for x in lines]], void, sigma)
    shown = content | ~void
    shown &= ~comment_lines(page, lines, shown)
    # Of an article's header the headings and what is content by its ratio stay.
    some = [i for i, x in enumerate(lines) if shown[i] and (content[i] or x[4] or not x[5])]
    lines, content = [lines[i] for i in some], content[some]
    if not lines:
        return ""
    chosen = choose(page, lines, content)
    return "\n\n".join(lines[i][0] for i in np.flatnonzero(chosen))


def choose(page: _Lines, lines: list[Line], content: np.ndarray) -> np.ndarray:
    """Which lines are the article's, given those that are content."""
    n_regions, parent, kind = len(page.kind), page.parent, page.kind
    at = np.array([x[3] for x in lines], int)
    chars = np.array([len(x[0]) for x in lines], float)
    linked = np.array([x[2] for x in lines], float)
    level = np.array([x[4] for x in lines], int)
    named = np.array(page.named)[at]

    def own(values: np.ndarray) -> np.ndarray:
        return np.bincount(at, weights=values, minlength=n_regions)

    def rolled(values: np.ndarray) -> np.ndarray:
        return _rolled(parent, own(values))

    free = chars - linked
    articles = _rolled(parent, np.array([k in NAMED and h == NOTHING for k, h in zip(kind, page.hints, strict=True)], float))
    # From the top to the container that holds the content. What a line weighs grows with its logarithm, so that lines count more than their lengths, and each counts.
    weight = (1 + np.log1p(free)) * content
    whole, direct = rolled(weight), own(weight)
    n_lines, size = rolled(np.ones(len(lines))), rolled(free)
    single = (n_lines == 1)[at]
    loose, loose_size = rolled(weight * single), rolled(free * single)
    titles = (level == 1) * (linked <= 0.5 * chars)
    n_titles = rolled(titles)
    heaviest = [-1] * n_regions
    for r in range(1, n_regions):
        p = parent[r]
        if heaviest[p] < 0 or whole[r] > whole[heaviest[p]]:
            heaviest[p] = r
    root = 0
    while (r := heaviest[root]) >= 0 and whole[r] > 0 and direct[root] == 0:
        if (n_titles[root] and not n_titles[r]) or (page.named[root] and not (kind[root] == "main" and articles[r])):
            break  # a title stands beside, or an article would be cut
        beside = whole[root] - whole[r]
        few = n_lines[r] > 1 and loose_size[root] - loose_size[r] <= LOOSE * size[r]
        if beside - (loose[root] - loose[r]) * few > (1 - DOMINANT) * whole[root]:
            break
        root = r
    # Below it, link lists go, and plain containers at the edges that have no content, or little beside the region's own and at most half their lines.
    under, menu, bare = [False] * n_regions, [False] * n_regions, [False] * n_regions
    under[root] = True
    n_linked, n_chars, filled = rolled(linked), rolled(chars), rolled(content * 1.0)
    mine = float((free * content)[at == root].sum())
    # A list between content lines of the region's own is a part of its text, whatever it links to.
    around = np.flatnonzero(content & (at == root))
    first, last = {}, {}
    for i, r in enumerate(at.tolist()):
        first.setdefault(r, i)
        last[r] = i
    for r in range(root + 1, n_regions):
        p = parent[r]
        under[r] = under[p]
        if under[r] and not page.named[r]:
            within = kind[r] in ITEMS and p == root and r in first and len(around) and around[0] < first[r] and around[-1] > last[r]
            menu[r] = menu[p] or (kind[r] in LISTS and not within and n_lines[r] >= 2 and n_linked[r] > 0.5 * n_chars[r] and filled[r] < 0.5 * n_lines[r])
            bare[r] = bare[p] or (kind[r] in PLAIN and (not filled[r] or (min(filled[r], n_lines[r] - 1) <= 0.5 * n_lines[r] and size[r] <= LOOSE * mine)))
    chosen = np.array(under)[at] & ~np.array(menu)[at]
    bare_line = np.array(bare)[at] | (~named & ~content & (linked > 0.5 * chars))
    spots = np.flatnonzero(content & chosen & ~bare_line)
    if len(spots):
        place = np.arange(len(lines))
        top = min(level[chosen & (level > 0)], default=0)
        title = (place < spots[0]) & (level > 0) & (level == top)
        chosen &= ~(((place < spots[0]) | (place > spots[-1])) & bare_line & ~title)
    for i in np.flatnonzero(chosen)[::-1]:
        if named[i] or not _COPYRIGHT.fullmatch(lines[i][0]):
            break
        chosen[i] = False
    return chosen


def extract_main(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` per row of ``pages``."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch[2].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch[0], batch[1], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
