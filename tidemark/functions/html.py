"""Pages to titles, blocks and texts as Spark expressions; image candidates and charsets through Arrow."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import NO_SOURCE_TITLE, col, collapse, looks_garbled, normalize_title, once, strip, unescape_html
from .urls import first_int, is_content_image, is_cover_url, resolve_img_src

MAX_TEXT = 20_000


class LenientParser(HTMLParser):
    """The standard parser, for which a marked section that it does not know (``<![foo[``) is a comment, as in browsers, and no error."""

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i, report)


def strip_noncontent(html: Column | str) -> Column:
    """Without script, style and noscript elements and comments."""
    out = F.regexp_replace(F.coalesce(col(html), F.lit("")), r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>", "")
    return F.regexp_replace(out, r"(?s)<!--.*?-->", "")


def page_blocks(html: Column | str, unclosed: bool = True) -> Column:
    """Texts of ``p``, ``li``, ``h2`` and ``h3`` in page order; a block ends at the next one's start or its own end."""
    marked = F.regexp_replace(strip_noncontent(html), r"(?i)<(?:p|li|h2|h3)(?:\s[^>]*)?>", "\x01")
    marked = F.regexp_replace(marked, r"(?i)</(?:p|li|h2|h3)\s*>", "\x02")
    parts = F.split(marked, "\x01", -1)
    inner = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x: F.substring_index(x, "\x02", 1))
    return F.transform(inner, lambda x: collapse(unescape_html(F.regexp_replace(x, r"<[^>]*>", " "), unclosed)))


def explode_blocks(pages: DataFrame, html: str = "html", unclosed: bool = True) -> DataFrame:
    """``(page_id, pos, text)`` of all blocks with text."""
    return pages.select("page_id", F.posexplode(page_blocks(html, unclosed)).alias("pos", "text")).filter("text != ''")


class _Nested(LenientParser):
    """Texts of ``p``, ``li``, ``h2`` and ``h3`` in the order of their starts, each with all that is nested in it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[list[str]] = []
        self.open: list[tuple[str, list[str] | None]] = []
        self.n_open: Counter[str] = Counter()
        self.silent = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("img", "meta", "br", "hr", "input", "link", "source", "wbr", "area", "base", "col", "embed", "track"):
            return
        block: list[str] | None = [] if tag in ("p", "li", "h2", "h3") else None
        if block is not None:
            self.found.append(block)
        self.open.append((tag, block))
        self.n_open[tag] += 1
        self.silent += tag in ("script", "style", "noscript")

    def handle_endtag(self, tag: str) -> None:
        while self.n_open[tag]:
            name, _ = self.open.pop()
            self.n_open[name] -= 1
            self.silent -= name in ("script", "style", "noscript")
            if name == tag:
                return

    def handle_data(self, data: str) -> None:
        text = data.strip()
        if text and not self.silent:
            for _, block in self.open:
                if block is not None:
                    block.append(text)


def nested_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """``(page_id, pos, text)`` as :func:`explode_blocks`, but a block holds the text of blocks nested in it, and an unclosed one all that follows inside
    its parent, so texts repeat. Nesting needs a parser."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for page_id, page in zip(pdf["page_id"], pdf["html"], strict=True):
                parser = _Nested()
                parser.feed(page or "")
                parser.close()
                rows += [(page_id, i, " ".join(x)) for i, x in enumerate(parser.found) if x]
            yield pd.DataFrame(rows, columns=["page_id", "pos", "text"])

    return pages.select("page_id", F.col(html).alias("html")).mapInPandas(run, "page_id long, pos int, text string")


def min_block(blocks: DataFrame, n: int = 25) -> DataFrame:
    return blocks.filter(F.length("text") >= n)


def assemble_text(blocks: DataFrame, cap: int = MAX_TEXT) -> DataFrame:
    """``(page_id, text)``: a page's blocks in order, one a line, at most ``cap`` characters."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return blocks.groupBy("page_id").agg(strip(F.substring(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n"), 1, cap)).alias("text"))


def block_text(html: Column | str, n: int = 25, cap: int = MAX_TEXT, unclosed: bool = True) -> Column:
    """The same without leaving the row: a page's blocks never need a shuffle."""
    kept = F.filter(page_blocks(html, unclosed), lambda x: F.length(x) >= n)
    return strip(F.substring(F.array_join(kept, "\n"), 1, cap))


def page_title(html: Column | str, hit_title: Column | str, aggregator: str = "google news", unclosed: bool = True) -> Column:
    """Title element, else the hit's title, else a placeholder; the hit's title also for an aggregator's name or a garbled one."""
    own = strip(unescape_html(F.regexp_extract(F.coalesce(col(html), F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1), unclosed))

    def first(x: Column) -> Column:
        title = F.when(x["own"] != "", x["own"]).when(x["hit"] != "", x["hit"]).otherwise(NO_SOURCE_TITLE)
        return F.struct(title.alias("title"), x["hit"].alias("hit"))

    def trusted(x: Column) -> Column:
        return F.when((x["hit"] != "") & ((F.lower(x["title"]) == aggregator) | looks_garbled(x["title"])), x["hit"]).otherwise(x["title"])

    both = F.struct(own.alias("own"), strip(F.coalesce(col(hit_title), F.lit(""))).alias("hit"))
    return normalize_title(once(once(both, first), trusted))


def page_text(text: Column | str, snippet: Column | str) -> Column:
    """The assembled text; the snippet if that is empty or garbled."""
    both = F.struct(F.coalesce(col(text), F.lit("")).alias("t"), F.coalesce(col(snippet), F.lit("")).alias("s"))
    full = once(both, lambda x: F.struct(F.when(x["t"] == "", x["s"]).otherwise(x["t"]).alias("t"), strip(x["s"]).alias("s")))
    return once(full, lambda x: F.when(looks_garbled(x["t"]) & (x["s"] != ""), x["s"]).otherwise(x["t"]))


class _Images(LenientParser):
    """Image candidates of a page: (priority, src, class, alt, width, height) in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []
        self.n_open: Counter[str] = Counter()
        self.depth = 0
        self.meta: set[int] = set()
        self.found: list[tuple[int, str, str, str, str, str]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in reversed(attrs)}
        if tag == "img":
            image = (a.get("src", ""), " ".join(a.get("class", "").split()), a.get("alt", ""), a.get("width", ""), a.get("height", ""))
            if self.depth:
                self.found.append((0, *image))
            self.found.append((3, *image))
        elif tag == "meta":
            kind = 1 if a.get("property") == "og:image" else 2 if a.get("name") == "twitter:image" else 0
            if kind and kind not in self.meta and a.get("content"):
                self.found.append((kind, a["content"], "", "", "", ""))
            if kind:
                self.meta.add(kind)
        if tag not in ("img", "meta", "br", "hr", "input", "link", "source", "wbr", "area", "base", "col", "embed", "track"):
            scope = tag in ("article", "main") or any(x in a.get(k, "") for k in ("class", "id") for x in ("content", "article"))
            self.open.append((tag, scope))
            self.n_open[tag] += 1
            self.depth += scope

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag: str) -> None:
        if self.n_open[tag]:
            while True:
                t, scope = self.open.pop()
                self.n_open[t] -= 1
                self.depth -= scope
                if t == tag:
                    break


def image_candidates(pages: DataFrame) -> DataFrame:
    """``(page_id, url, pos, priority, src, class, alt, width, height)``; src is absolute. Container nesting needs a parser."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for page_id, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"], strict=True):
                parser = _Images()
                parser.feed(html or "")
                parser.close()
                rows += [(page_id, url, i, *x) for i, x in enumerate(parser.found)]
            yield pd.DataFrame(rows, columns=["page_id", "url", "pos", "priority", "src", "class", "alt", "w", "h"])

    raw = pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, pos int, priority int, src string, class string, alt string, w string, h string")
    return raw.select("page_id", "url", "pos", "priority", resolve_img_src("src", "url").alias("src"), "class", "alt", first_int("w").alias("width"), first_int("h").alias("height")).filter("src IS NOT NULL")


def pick_cover(candidates: DataFrame) -> DataFrame:
    """``(page_id, cover_url)``: the first usable candidate of the best class (in-article, og, twitter, any image)."""
    meta = F.col("priority").isin(1, 2)
    usable = F.when(meta, is_cover_url("src")).otherwise(is_content_image(F.struct("src", "class", "alt", "width", "height")))
    return candidates.filter(usable).groupBy("page_id").agg(F.min_by("src", F.struct("priority", "pos")).alias("cover_url"))


_CHARSET = re.compile(r"charset=([A-Za-z0-9_\-]+)")
#: Counts Chinese characters; with ``compat`` the class that scores as ``[一-鿿]`` written with a doubled backslash does.
_CJK, _CJK_COMPAT = re.compile("[一-鿿]"), re.compile(r"[\\u4e00-\\u9fff]")
_BAD = re.compile("[�Ãâ¤ï¿½]")


def decode_bytes(body: Column | str, encoding: Column | str, content_type: Column | str, compat: bool = True) -> Column:
    """Text of raw bytes: of the declared, the header's and the usual charsets, the one with the best score; ties to the first.

    The score is the count of characters of a class less three times the garbled ones. ``compat``: the class as written in the
    source of these semantics, nearly the same for all charsets, so that the first one without garbled characters wins.
    Otherwise Chinese characters are counted. Bytes that are whole UTF-8 are not tried in Chinese charsets that nobody declared: letters
    such as ``â`` and ``ï`` count as garbled, so French in UTF-8 would score better as GB.
    """

    @F.pandas_udf("string")
    def decode(body: pd.Series, encoding: pd.Series, content_type: pd.Series) -> pd.Series:
        good = _CJK_COMPAT if compat else _CJK

        def one(raw: bytes | None, enc: str | None, kind: str | None) -> str:
            if not raw:
                return ""
            header = _CHARSET.search((kind or "").lower())
            names = [(enc or "").strip().lower(), header[1] if header else "", "utf-8"]
            best, top = bytes(raw).decode("utf-8", "ignore"), -1.0
            if best.encode() != bytes(raw):
                names += ["gb18030", "gbk", "big5"]
            for name in dict.fromkeys(n for n in names if n):
                try:
                    text = bytes(raw).decode(name, "ignore")
                except LookupError:
                    continue
                score = float(len(good.findall(text)) - 3 * len(_BAD.findall(text)))
                if text and score > top:
                    best, top = text, score
            return best

        return pd.Series([one(*x) for x in zip(body, encoding, content_type, strict=True)], dtype=object)

    return decode(col(body), col(encoding), col(content_type))
