"""Text functions as Spark expressions. A column may be given by name."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
#: White space as Python's str.split and str.strip know it.
WS = r"[\x09-\x0d\x1c-\x20\x85\p{Z}]"
UNTITLED = "未命名"
NO_SOURCE_TITLE = "来源文章"
SUMMARY_HEAD = "【摘要】"
#: Characters that a wrong decoding leaves behind.
GARBLED = "�Ãâ¤ï¿½"
#: Endings of a title's last part that name a source.
SOURCE_ENDINGS = "网|报|社|台|频道|新闻|资讯|财经|日报|晚报|观察|客户端|之声|news|finance|cn|com"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` written out, and computed, one time however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"^{WS}+|{WS}+$", "")


def collapse(c: Column | str) -> Column:
    """White-space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(col(c), f"{WS}+", " "))


def norm_text(c: Column | str) -> Column:
    """Lower case, letters, digits and underscore only."""
    return F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"[^\p{L}\p{N}_]", "")


def title_key(c: Column | str) -> Column:
    """Lower case without white space; punctuation stays."""
    return F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), WS, "")


def plain_length(c: Column | str) -> Column:
    return F.length(F.regexp_replace(F.coalesce(col(c), F.lit("")), WS, ""))


def is_too_short(c: Column | str, n: int = 100) -> Column:
    return plain_length(c) < n


def looks_garbled(c: Column | str, marks: str = GARBLED, at_least: int = 3) -> Column:
    kinds = "".join(f"\\x{{{ord(x):04X}}}" for x in dict.fromkeys(marks))
    return F.regexp_count(F.coalesce(col(c), F.lit("")), F.lit(f"[{kinds}]")) >= at_least


def normalize_title(c: Column | str, max_tail: int = 16) -> Column:
    """Collapse white space and cut the last part, up to three times, if it is empty, short or names a source."""
    title = collapse(F.coalesce(col(c), F.lit("")))
    for _ in range(3):
        title = _cut_tail(title, max_tail)
    return once(title, lambda t: F.when(t == "", UNTITLED).otherwise(t))


def _cut_tail(title: Column, max_tail: int) -> Column:
    def cut(p: Column) -> Column:
        tail = F.replace(strip(F.element_at(p["parts"], -1)), F.lit(" "), F.lit(""))
        rest = strip(F.array_join(F.slice(p["parts"], F.lit(1), F.size(p["parts"]) - 1), " - "))
        goes = once(tail, lambda x: (x == "") | (F.length(x) <= max_tail) | x.rlike(f"(?i)({SOURCE_ENDINGS})$"))
        return F.when((F.size(p["parts"]) >= 2) & goes, rest).otherwise(p["whole"])

    return once(once(title, lambda t: F.struct(t.alias("whole"), F.split(t, r" *[-|—_]+ *", -1).alias("parts"))), cut)


def _entity_tables() -> tuple[dict[str, str], dict[str, str]]:
    """Names that end in ``;`` and those that need none (the standard library's table); the usual ones first, as look-ups go in order."""
    usual = ("amp;", "quot;", "lt;", "gt;", "nbsp;", "apos;", "copy;", "middot;", "mdash;", "ndash;", "hellip;", "lsquo;", "rsquo;", "ldquo;", "rdquo;", "eacute;")
    closed = {k[:-1]: html5[k] for k in (*usual, *html5) if k.endswith(";")}
    return closed, {k: v for k, v in html5.items() if not k.endswith(";")}


_CLOSED, _LEGACY = _entity_tables()
_LEGACY_NAME = "^(?:" + "|".join(sorted(_LEGACY, key=lambda k: (-len(k), k))) + ")"


def _windows_1252(code: int) -> str:
    try:
        return bytes([code]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(code)


#: What numeric references to 0, 13 and the range 128-159 stand for.
_ODD_CODES = {"0": "\ufffd", "13": "\r"} | {str(i): _windows_1252(i) for i in range(0x80, 0xA0)}


def _table(entries: dict[str, str]) -> Column:
    """A constant map; the optimizer folds it once."""
    return F.from_json(F.lit(json.dumps(entries)), F.lit("map<string,string>"))


def _reference(p: Column, unclosed: bool) -> Column:
    """A piece of text that followed an ``&``, with the reference that it starts with replaced."""
    number = F.regexp_extract(p, "^#(?:0*[0-9]+|[xX]0*[0-9a-fA-F]+);?", 0)
    name = F.regexp_extract(p, "^[A-Za-z][A-Za-z0-9]{0,30};", 0)
    bare = F.regexp_extract(p, _LEGACY_NAME, 0) if unclosed else F.lit("")

    def numeric(m: Column) -> Column:
        is_hex = m.rlike("^#[xX]")
        digits = F.regexp_replace(m, "^#[xX]?0*|;$", "")
        code = F.when(F.length(digits) > F.when(is_hex, 6).otherwise(7), 0x110000).when(digits == "", 0).when(is_hex, F.try_to_number(F.conv(digits, 16, 10), F.lit("99999999")).cast("int")).otherwise(digits.try_cast("int"))
        return once(code, char)

    def char(c: Column) -> Column:
        nothing = (c < 9) | (c == 11) | c.between(14, 31) | (c == 127) | c.between(0xFDD0, 0xFDEF) | (F.pmod(c, F.lit(0x10000)) >= 0xFFFE)
        own = F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")
        return F.coalesce(F.try_element_at(_table(_ODD_CODES), c.cast("string")), F.when(c.between(0xD800, 0xDFFF) | (c > 0x10FFFF), "\ufffd").when(nothing, "").otherwise(own))

    found = F.struct(number.alias("number"), name.alias("name"), F.when(name != "", F.try_element_at(_table(_CLOSED), F.rtrim(name, F.lit(";")))).alias("closed"), bare.alias("bare"))

    def replaced(m: Column) -> Column:
        rest = lambda x: F.substring(p, F.length(x) + 1, F.length(p))
        return (
            F.when(m["number"] != "", F.concat(once(m["number"], numeric), rest(m["number"])))
            .when(m["closed"].isNotNull(), F.concat(m["closed"], rest(m["name"])))
            .when(m["bare"] != "", F.concat(F.try_element_at(_table(_LEGACY), m["bare"]), rest(m["bare"])))
            .otherwise(F.concat(F.lit("&"), p))
        )

    return once(found, replaced)


def unescape_html(c: Column | str, unclosed: bool = True) -> Column:
    """All named and numeric character references to characters, by the rules of browsers: unknown ones stay, some names need no ``;``.

    Without ``unclosed`` names that lack their ``;`` stay too, as a reference that was cut off (``&amp``) or text with a bare ``&``.
    """
    text = col(c)
    parts = lambda t: F.split(t, "&", -1)
    whole = once(F.struct(text.alias("t")), lambda x: once(parts(x["t"]), lambda ps: F.concat(F.get(ps, F.lit(0)), F.array_join(F.transform(F.slice(ps, F.lit(2), F.size(ps)), lambda p: _reference(p, unclosed)), ""))))
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


def normalize_snippet(c: Column | str, unclosed: bool = True) -> Column:
    """Tags to spaces, entities decoded, ``**`` removed, white space collapsed."""
    plain = once(F.regexp_replace(F.coalesce(col(c), F.lit("")), "<[^>]+>", " "), lambda x: unescape_html(x, unclosed))
    return collapse(F.replace(plain, F.lit("**"), F.lit("")))


def feed_title(title: Column | str, description: Column | str, aggregator: str = "google news", unclosed: bool = True) -> Column:
    """A feed item's title; if it is empty or the aggregator's own name, the first link text of the description."""
    said = F.coalesce(col(description), F.lit(""))
    link = F.regexp_extract(said, r"(?is)<a[^>]*>(.*?)</a>", 1)
    text = strip(unescape_html(F.regexp_replace(link, "<[^>]+>", ""), unclosed))

    def choose(x: Column) -> Column:
        own = F.when(x["title"] == "", UNTITLED).otherwise(x["title"])
        good = (x["title"] != "") & (F.lower(x["title"]) != aggregator)
        return F.struct(F.when(good, x["title"]).when(x["text"] != "", x["text"]).otherwise(own).alias("title"), (good | x["linked"]).alias("clean"))

    picked = once(F.struct(strip(F.coalesce(col(title), F.lit(""))).alias("title"), text.alias("text"), said.rlike(r"(?is)<a[^>]*>.*?</a>").alias("linked")), choose)
    return once(picked, lambda x: F.when(x["clean"], normalize_title(x["title"])).otherwise(x["title"]))


def sanitize_summary(c: Column | str) -> Column:
    """No ``**``, one kind of newline, no white space at line ends or around the whole."""
    out = F.replace(F.coalesce(col(c), F.lit("")), F.lit("**"), F.lit(""))
    out = F.regexp_replace(out, "\r\n?", "\n")
    return strip(F.regexp_replace(out, f"(?:(?!\n){WS})+(?=\n|$)", ""))


def fallback_summary(title: Column | str, text: Column | str, n: int = 2200) -> Column:
    body = F.substring(collapse(F.coalesce(col(text), F.lit(""))), 1, n - 20)
    return sanitize_summary(F.concat(F.lit(SUMMARY_HEAD), F.coalesce(col(title), F.lit("")), F.lit("\n"), body))


def parse_list(c: Column | str) -> Column:
    """Comma list (ASCII or full-width) to an array of trimmed, non-blank items in order."""
    items = F.transform(F.split(F.replace(F.coalesce(col(c), F.lit("")), F.lit("，"), F.lit(",")), ","), strip)
    return F.filter(items, lambda x: x != "")


def normalize_site(c: Column | str) -> Column:
    """Bare lower-case host of a site entry: no scheme, path or ``www.``."""
    site = F.replace(F.replace(F.lower(col(c)), F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))
    site = F.regexp_replace(strip(site), "^/+|/+$", "")
    return F.regexp_replace(F.split_part(site, F.lit("/"), F.lit(1)), r"^www\.", "")


def distinct_sites(c: Column | str) -> Column:
    """Normalised sites of a list, each once, first occurrence first."""
    return F.array_distinct(F.filter(F.transform(parse_list(c), normalize_site), lambda x: x != ""))
