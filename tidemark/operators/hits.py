"""Hit lists: filters, ordered merges, caps and keyed joins.

A hit row is ``query, query_ord, tool, tool_rank, scope_rank, pos, title, url, snippet, published_at``; list order is always given by
columns, never by partitions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.patterns import MAX_PATTERNS, Patterns, contains_any, evaluate
from ..functions.text import col, once, strip
from ..functions.urls import canonical_url, norm_url, url_host
from ..runtime import broadcast_if_small, broadcast_within, in_blocks, materialize

# Fixed values.
BLOCKED_HOSTS = ("baike.baidu.com", "wikipedia.org", "zh.wikipedia.org", "en.wikipedia.org", "hudong.com", "baike.com")
#: Rows of a list table (sites, keywords, aliases) that are broadcast.
MAX_LIST = 100_000
#: Size of a lookup table that is broadcast.
MAX_LOOKUP_MB = 64
HIT_ORDER = ("query_ord", "scope_rank", "pos")
#: ``scope_rank`` of hits that no site list limits; those of a site have the site's place.
GLOBAL = 1 << 20


def require(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows whose ``cols`` all hold more than white space."""
    return df.filter(reduce(lambda a, b: a & b, [F.length(strip(F.coalesce(F.col(c), F.lit("")))) > 0 for c in cols]))


def block_text(url: Column | str) -> Column:
    """What a blocklist looks at: the host, or the whole URL in lower case if its brackets hold no address, so that it cannot be parsed."""
    netloc = F.regexp_extract(strip(F.coalesce(col(url), F.lit(""))), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)
    odd = once(netloc, lambda n: n.rlike(r"[\[\]]") & ~n.rlike(r"^[^\[\]]*\[(?:[0-9A-Fa-f:.]+(?:%[^\[\]]*)?|[vV][0-9A-Fa-f]+\.[^\[\]]+)\](?::[^\[\]]*)?$"))
    return F.when(odd, F.lower(strip(col(url)))).otherwise(url_host(url))


def is_blocked(url: Column | str, domains: Sequence[str] = BLOCKED_HOSTS, suffix: bool = False) -> Column:
    """Blank URL, or the host contains a listed domain (``suffix``: is it or is below it)."""
    host = block_text(url)
    match = lambda d: (host == d) | F.endswith(host, F.lit("." + d)) if suffix else F.contains(host, F.lit(d))
    hit = reduce(lambda a, b: a | b, [match(d) for d in domains], F.lit(False))
    return (strip(F.coalesce(col(url), F.lit(""))) == "") | hit


def host_blocklist(df: DataFrame, url: str = "url", domains: Sequence[str] | DataFrame = BLOCKED_HOSTS) -> DataFrame:
    """Rows that are not blocked. A list of domains becomes an expression; a table ``(value)`` is looked for in each host in one walk, in blocks of ``MAX_LIST``."""
    if not isinstance(domains, DataFrame):
        return df.filter(~is_blocked(url, domains))
    hosted = df.withColumn("__host", block_text(url)).filter(strip(F.coalesce(F.col(url), F.lit(""))) != "")
    for block in in_blocks(domains.select("value").filter("value IS NOT NULL").distinct(), "value", MAX_LIST):
        hosted = hosted.filter(~contains_any(df.sparkSession, F.col("__host"), [r["value"] for r in block.collect()]))
    return hosted.drop("__host")


def filter_by_age(df: DataFrame, ts: str, max_hours: int, as_of: Column) -> DataFrame:
    """Rows not older than ``max_hours`` at ``as_of``; without a time they go, unless ``max_hours`` is 0 or less (keep all)."""
    if max_hours <= 0:
        return df
    return df.filter(F.col(ts) >= as_of - F.make_dt_interval(hours=F.lit(max_hours)))


def site_scope(df: DataFrame, sites: DataFrame, url: str = "url") -> DataFrame:
    """Rows of the listed sites ``(value)`` and their subdomains, with the ``site`` they fit. An equi-join on the host's suffixes."""
    parts = F.split("__host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."))
    each = df.withColumn("__host", url_host(url)).withColumn("site", F.explode(suffixes)).drop("__host")
    return each.join(broadcast_if_small(sites.select(F.col("value").alias("site")).distinct(), MAX_LIST), "site")


def rank_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int = 1) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def dedupe_hits(df: DataFrame, partition: Sequence[str], order: Sequence[str], n: int | None, url: str = "url", domains: Sequence[str] = BLOCKED_HOSTS) -> DataFrame:
    """In order: blank, blocked and seen URLs go, then the first ``n`` (None: all) of each partition stay."""
    keyed = host_blocklist(df, url, domains).withColumn("__key", norm_url(url)).filter("__key != ''")
    first = rank_first(keyed, [*partition, "__key"], order)
    return (first if n is None else rank_first(first, partition, order, n)).drop("__key")


def site_cap(max_results: int) -> int:
    return max(3, min(max_results, 10))


def cap_per_site(df: DataFrame, max_results: int, keys: Sequence[str] = ("query", "tool", "site"), order: Sequence[str] = ("pos",)) -> DataFrame:
    return rank_first(df, keys, order, site_cap(max_results))


def top_candidates(df: DataFrame, n: int | None = 20, order: Sequence[str] = HIT_ORDER) -> DataFrame:
    """The first ``n`` rows, a top-k that every task keeps for itself first; None keeps all."""
    return df if n is None else df.orderBy(*order).limit(n)


def priority_union(scoped: DataFrame, everywhere: DataFrame) -> DataFrame:
    """Site-scoped hits (their ``scope_rank`` is the site's place, from 0) before the global ones."""
    return scoped.unionByName(everywhere.withColumn("scope_rank", F.lit(GLOBAL)))


def site_then_global(df: DataFrame, max_results: int | None, domains: Sequence[str] = BLOCKED_HOSTS) -> DataFrame:
    """Each tool's hits of each query as one list: sites in their order, then global hits, every call deduped and capped, then the whole."""
    of, call = ["query", "tool_rank"], ["query", "tool_rank", "scope_rank"]
    if max_results is not None:
        sites = dedupe_hits(df.filter(F.col("scope_rank") < GLOBAL), call, ["pos"], site_cap(max_results), domains=domains)
        df = sites.unionByName(dedupe_hits(df.filter(F.col("scope_rank") >= GLOBAL), call, ["pos"], max_results, domains=domains))
    return dedupe_hits(df, of, ["scope_rank", "pos"], max_results, domains=domains)


def union_queries(frames: Sequence[DataFrame]) -> DataFrame:
    """All queries' hits; ``query_ord`` is the frame's place."""
    return reduce(DataFrame.unionByName, [f.withColumn("query_ord", F.lit(i)) for i, f in enumerate(frames)])


def first_by_key(df: DataFrame, key: Column, order: Sequence[str]) -> DataFrame:
    """The first row of each non-empty key. Partial aggregation, so a hot key costs no more than others."""
    keyed = df.withColumn("__key", key).filter("__key != ''")
    best = keyed.groupBy("__key").agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("__row"))
    return best.select("__row.*")


def unique_candidates(df: DataFrame, order: Sequence[str] = HIT_ORDER, url: str = "url") -> DataFrame:
    return first_by_key(df, canonical_url(url), order)


def assert_unique(df: DataFrame, key: Column) -> DataFrame:
    """``df``, or an error naming a key that occurs twice."""
    twice = df.groupBy(key.alias("key")).count().filter("key != '' AND count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"key occurs {twice[0]['count']} times: {twice[0]['key']}")
    return df


def rows_per_query(df: DataFrame) -> DataFrame:
    return df.groupBy("query", "tool").agg(F.count("*").alias("n_rows"))


def pick_source(df: DataFrame) -> DataFrame:
    """``(query, tool)``: the first tool, by rank, that has rows for the query."""
    return df.groupBy("query").agg(F.min_by("tool", "tool_rank").alias("tool"))


def from_first_source(df: DataFrame) -> DataFrame:
    """Only the rows of each query's first tool with rows."""
    first = df.groupBy("query").agg(F.min("tool_rank").alias("tool_rank"))
    return df.join(first, ["query", "tool_rank"]).select(*df.columns)


def assert_covered(queries: DataFrame, hits: DataFrame, report: bool = False) -> DataFrame:
    """Queries ``(value)`` without any hit: an error, or with ``report`` the rows."""
    bare = queries.join(hits.select(F.col("query").alias("value")).distinct(), "value", "left_anti")
    if report:
        return bare
    rows = bare.limit(20).collect()
    if rows:
        raise RuntimeError("no source has rows for: " + ", ".join(r["value"] for r in rows))
    return bare


def keyword_hits(queries: DataFrame, corpus: DataFrame, text: str = "text") -> DataFrame:
    """``corpus`` rows that hold all space-separated terms of a query ``(ord, value)``, case-insensitively.

    One walk over each text finds all terms of all queries in it, or of a block of ``MAX_LIST`` queries; a query is looked at where its longest term is found.
    """
    spark = corpus.sparkSession
    terms = F.filter(F.split(F.lower("value"), " "), lambda t: t != "")
    q = queries.select(F.col("ord").alias("query_ord"), F.col("value").alias("query"), F.array_distinct(terms).alias("terms")).filter(F.size("terms") > 0).distinct()
    q = materialize(q.withColumn("id", F.xxhash64("query_ord", "query")), "keywords")
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    found = []
    for block in in_blocks(q, "id", MAX_LIST):
        # At most about MAX_LIST rows, and no more terms than an automaton takes.
        rows = block.select("id", "terms").collect()
        for part in _bounded(rows, MAX_PATTERNS):
            known = {t: i for i, t in enumerate(sorted({t for r in part for t in r["terms"]}))}
            by: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
            for r in part:
                first = max(r["terms"], key=len)
                by.setdefault(known[first], []).append((r["id"], tuple(known[t] for t in r["terms"] if t != first)))

            def held(seen: set[int], by: dict[int, list[tuple[int, tuple[int, ...]]]] = by) -> list[int]:
                return [i for t in seen for i, rest in by.get(t, ()) if seen.issuperset(rest)]

            which = evaluate([Patterns(spark, list(known))], [low], held, "array<long>")
            found.append(corpus.withColumn("__query", F.explode(which)))
    named = broadcast_within(q.select(F.col("id").alias("__query"), "query_ord", "query"), MAX_LOOKUP_MB)
    every = reduce(DataFrame.unionByName, found) if found else corpus.withColumn("__query", F.lit(None).cast("long")).limit(0)
    return every.join(named, "__query").drop("__query")


def _bounded(rows: list[Row], most: int) -> Iterator[list[Row]]:
    """``rows`` in parts of ``most`` terms at most, or one row."""
    part, n = [], 0
    for r in rows:
        if part and n + len(r["terms"]) > most:
            yield part
            part, n = [], 0
        part.append(r)
        n += len(r["terms"])
    if part:
        yield part


def resolve_alias(hits: DataFrame, alias: DataFrame, host: str = "news.google.com", url: str = "url") -> DataFrame:
    """Replace URLs of the aggregator ``host`` by their known target ``(url, target)``."""
    known = alias.groupBy(F.col("url").alias("__from")).agg(F.min(strip("target")).alias("__to"))
    own = F.when(F.contains(url_host(url), F.lit(host)), strip(F.col(url)))
    out = hits.withColumn("__own", own).join(broadcast_if_small(known, MAX_LIST), F.col("__own") == F.col("__from"), "left")
    return out.withColumn(url, F.coalesce(F.nullif("__to", F.lit("")), F.col(url))).select(*hits.columns)


def with_default(df: DataFrame, lookup: DataFrame, key: str, lookup_key: str, value: str, default: Column, rejected: str | None = None) -> DataFrame:
    """``df`` with ``value`` from ``lookup``; ``default`` if the key is unknown, blank or (column ``rejected``) turned down."""
    cols = [F.col(lookup_key).alias("__k"), F.col(value).alias("__v"), (F.col(rejected) if rejected else F.lit(False)).alias("__no")]
    out = df.join(broadcast_within(lookup.select(*cols), MAX_LOOKUP_MB), F.col(key) == F.col("__k"), "left")
    ok = ~F.coalesce("__no", F.lit(False)) & (strip(F.coalesce("__v", F.lit(""))) != "")
    return out.withColumn(value, F.when(ok, F.col("__v")).otherwise(default)).drop("__k", "__v", "__no")
