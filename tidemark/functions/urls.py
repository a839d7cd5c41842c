"""URL functions as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, once, strip

_SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
# Fixed values.
#: Hosts whose article URLs are identified by their path alone, and that path's start.
AGGREGATOR_HOST, AGGREGATOR_PATH = "news.google.com", "/rss/articles/"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, _SPLIT, i)


def _decode(x: Column) -> Column:
    """Percent decoding; text that is not decodable stays."""
    return F.coalesce(F.try_url_decode(x), F.replace(x, F.lit("+"), F.lit(" ")))


def _encode(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def sort_params(kv: Column) -> Column:
    """An array of (k, v) structs by key, then value."""
    return F.array_sort(kv)


def query_params(query: Column) -> Column:
    """Decoded parameters with a value, as an array of (k, v)."""
    has = F.filter(F.split(query, "&"), lambda x: F.locate("=", x) > 0)
    pairs = F.transform(
        has,
        lambda x: F.struct(
            _decode(F.substring_index(x, "=", 1)).alias("k"),
            _decode(F.substring(x, F.locate("=", x) + 1, F.length(x))).alias("v"),
        ),
    )
    return F.filter(pairs, lambda p: p["v"] != "")


def canonical_url(url: Column | str, host: str = AGGREGATOR_HOST, path_start: str = AGGREGATOR_PATH) -> Column:
    """Key of a URL: scheme and host lower-cased (default https), no path end slash, ``;params``, fragment, blank or
    ``utm_`` parameters; parameters sorted and encoded anew. A blank URL gives ``""``."""
    def split(raw: Column) -> Column:
        scheme = F.lower(_part(raw, 1))
        return F.struct(
            raw.alias("raw"),
            F.when(scheme == "", "https").otherwise(scheme).alias("scheme"),
            F.lower(_part(raw, 2)).alias("netloc"),
            F.regexp_replace(F.regexp_replace(_part(raw, 3), ";[^/]*$", ""), "/+$", "").alias("path"),
            F.filter(query_params(_part(raw, 4)), lambda p: ~F.startswith(F.lower(p["k"]), F.lit("utm_"))).alias("kv"),
        )

    def join(x: Column) -> Column:
        netloc, path = x["netloc"], x["path"]
        rooted = (path == "") | F.startswith(path, F.lit("/"))
        slash = F.when(rooted, "").otherwise("/")
        place = F.when(netloc != "", F.concat(F.lit("//"), netloc, slash, path)).when(rooted, F.concat(F.lit("//"), path)).otherwise(path)
        query = F.array_join(F.transform(sort_params(x["kv"]), lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&")
        return F.struct(x["raw"].alias("raw"), F.concat(x["scheme"], F.lit(":"), place).alias("base"), query.alias("query"), (F.endswith(netloc, F.lit(host)) & F.startswith(path, F.lit(path_start))).alias("by_path"))

    def show(x: Column) -> Column:
        full = F.concat(x["base"], F.when(x["query"] == "", "").otherwise(F.concat(F.lit("?"), x["query"])))
        return F.when(x["raw"] == "", "").when(x["by_path"], x["base"]).otherwise(F.regexp_replace(full, "/+$", ""))

    return once(once(once(strip(F.coalesce(col(url), F.lit(""))), split), join), show)


def norm_url(url: Column | str) -> Column:
    return F.regexp_replace(F.lower(strip(F.coalesce(col(url), F.lit("")))), "/+$", "")


def url_host(url: Column | str) -> Column:
    """Lower-case host without user info and port; ``""`` if there is none."""
    return F.lower(F.regexp_extract(strip(F.coalesce(col(url), F.lit(""))), r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:@]*)", 1))


def _no_dots(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments of an absolute path."""
    parts = F.split(path, "/", -1)
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))),
    )
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
    return F.when(last.isin(".", "..") & (joined != "/"), F.concat(joined, F.lit("/"))).otherwise(joined)


def resolve_img_src(src: Column | str, base: Column | str) -> Column:
    """Absolute URL of an image source against its page; null for a blank or ``data:`` source."""
    s, b = strip(F.coalesce(col(src), F.lit(""))), strip(F.coalesce(col(base), F.lit("")))
    root = F.concat(F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*:)?", 0), F.regexp_extract(b, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(//[^/?#]*)?", 1))
    path, tail = F.regexp_extract(s, r"^[^?#]*", 0), F.regexp_extract(s, r"^[^?#]*(.*)$", 1)
    folder = F.regexp_replace(_part(b, 3), "[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when((s == "") | F.startswith(s, F.lit("data:")), F.lit(None).cast("string"))
        .when(s.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), s)
        .when(F.startswith(s, F.lit("//")), F.concat(_part(b, 1), F.lit(":"), s))
        .when(F.startswith(s, F.lit("/")), F.concat(root, _no_dots(path), tail))
        .when(F.startswith(s, F.lit("?")), F.concat(root, _part(b, 3), s))
        .when(F.startswith(s, F.lit("#")), F.concat(F.regexp_replace(b, "#.*$", ""), s))
        .otherwise(F.concat(root, _no_dots(F.concat(folder, path)), tail))
    )


def first_int(c: Column | str) -> Column:
    return F.coalesce(F.regexp_extract(F.coalesce(col(c), F.lit("")), r"[0-9]+", 0).try_cast("int"), F.lit(0))


def is_cover_url(url: Column | str) -> Column:
    return ~col(url).rlike("(?i)logo|icon|avatar|sprite|favicon")


def is_content_image(cand: Column) -> Column:
    """An image candidate struct (src, class, alt, width, height) that may illustrate an article: big enough, no logo."""
    small = ((cand["width"] > 0) & (cand["width"] < 200)) | ((cand["height"] > 0) & (cand["height"] < 120))
    named = F.concat_ws(" ", cand["class"], cand["alt"], cand["src"]).rlike("(?i)logo|icon|avatar|qrcode|二维码")
    return is_cover_url(cand["src"]) & ~small & ~named
