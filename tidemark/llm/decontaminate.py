"""Benchmark decontamination: a prefix-filtered set join of documents with benchmark windows, in DataFrame operations only.

A window (``window`` consecutive words of an item, or all words of a shorter one) is the set of its shingles of ``shingle``
words. It is contained in a document place only if all its shingles are, so the prefix that has to be looked up is one
shingle: the rarest in the corpus. A first pass over the documents counts the benchmark's shingles (partial sums before the shuffle, one row a
shingle after it). A second one looks up each window's rarest shingle only, bounds by position and length (the window has to start and end inside
the document), and compares the window's words with those of the document there; what it writes are exact hits. Windows with a shingle that
never occurs are out before it.

Both passes join the documents' places with a broadcast of the benchmark's shingles or windows, in blocks of at most ``MAX_KEYS`` rows (a larger
benchmark takes more passes, not more memory): no text is shuffled, and a shingle that many documents share meets no single task.

Defined cases: null and empty texts have no words (and are not contaminated); an item without words has no window; two
items with equal text both count; null item_id is ignored; rows of documents with the same id and text share their result and
all stay; rows with the same id and other text are judged apart; null doc_id is an id like others; empty tables
give no rows or no hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import all_columns, broadcast_if_small, free_names, materialize, null_safe, text_key

#: Everything that separates words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shingle keys (16 bytes) or windows (about 100 bytes) in one broadcast, before hashing overhead.
MAX_KEYS = 500_000
#: Contaminated rows (16 bytes each) that are broadcast to drop them; with more, the documents are shuffled.
MAX_BAD = 1_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")


def count_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP_ANY_CASE), "")).cast("long")


def _key(words: str, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(F.col(words), at + j) for j in range(k)])


def item_windows(benchmark: DataFrame, window: int = 10, shingle: int = 3) -> DataFrame:
    """``(item_id, window_id, words, n, offset, key, k)``: each distinct window's shingles with their offsets."""
    items = benchmark.filter("item_id IS NOT NULL").select("item_id", words_of(F.col("text")).alias("ws")).filter(F.size("ws") > 0)
    n = F.least(F.lit(window), F.size("ws"))
    spots = items.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("ws") - n + 1), lambda i: F.slice("ws", i, n))).alias("words"))
    each = spots.groupBy("words").agg(F.collect_set("item_id").alias("items")).withColumn("window_id", F.xxhash64("words")).withColumn("n", F.size("words"))
    k = F.least(F.lit(shingle), F.col("n"))
    out = each.withColumn("k", k).withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("k"))))
    key = F.lit(None).cast("long")
    for size in range(1, shingle + 1):
        key = F.when(F.col("k") == size, _key("words", F.col("offset"), size)).otherwise(key)
    return out.withColumn("key", key)


def _places(docs: DataFrame, k: int) -> DataFrame:
    """``(doc_id, row, ws, n_words, pos, key)``: each place where a shingle of ``k`` words starts."""
    base = docs.select("doc_id", text_key("text").alias("row"), words_of(F.col("text")).alias("ws")).withColumn("n_words", F.size("ws"))
    spots = base.select("doc_id", "row", "ws", "n_words", F.posexplode("ws").alias("pos", "w")).filter(F.col("pos") <= F.col("n_words") - k)
    return spots.withColumn("key", _key("ws", F.col("pos"), k))


def _blocks(rows: DataFrame, sizes: list[int], max_keys: int) -> list[tuple[int, DataFrame]]:
    """``rows`` (with k and key) by size of shingle and in blocks to broadcast."""
    n = max(1, -(-rows.count() // max_keys))
    return [(k, rows.filter((F.col("k") == k) & (F.pmod(F.xxhash64("key", "window_id"), F.lit(n)) == b))) for k in sizes for b in range(n)]


def shingle_counts(docs: DataFrame, keys: DataFrame, sizes: list[int], max_keys: int = MAX_KEYS) -> DataFrame:
    """``(k, key, df)``: how often each benchmark shingle ``(k, key)`` occurs in the corpus; those that do not are missing."""
    found = None
    for k, block in _blocks(keys.withColumn("window_id", F.lit(0)), sizes, max_keys):
        each = _places(docs, k).select("key").join(F.broadcast(block.select("key")), "key").groupBy("key").agg(F.count("*").alias("df")).withColumn("k", F.lit(k))
        found = each if found is None else found.unionByName(each)
    return found


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3, max_keys: int = MAX_KEYS) -> DataFrame:
    """``(doc_id, row, start, n, items)``: each place of a document where a benchmark window occurs, exactly."""
    grid = materialize(item_windows(benchmark, window, shingle), "windows")
    keys = grid.select("k", "key").distinct()
    sizes = sorted(r["k"] for r in keys.select("k").distinct().collect())
    if not sizes:
        kind = benchmark.schema["item_id"].dataType
        schema = T.StructType([docs.schema["doc_id"], T.StructField("row", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("items", T.ArrayType(kind))])
        return docs.sparkSession.createDataFrame([], schema)
    # Rarity of each shingle in the corpus; a window with a shingle that never occurs cannot occur either.
    counts = materialize(shingle_counts(docs, keys, sizes, max_keys), "shingle-counts")
    ranked = grid.select("window_id", "k", "key", "offset").join(counts, ["k", "key"], "left")
    prefix = ranked.groupBy("window_id", "k").agg(F.count("*").alias("have"), F.count("df").alias("seen"), F.min(F.struct("df", "offset", "key")).alias("first")).filter("have = seen")
    words = grid.filter("offset = 0").select("window_id", "words", "n", "items")
    prefix = materialize(prefix.select("window_id", "k", F.col("first.offset").alias("offset"), F.col("first.key").alias("key")).join(words.drop("items"), "window_id"), "prefixes")
    start, hits = F.col("pos") - F.col("offset"), None
    for k, block in _blocks(prefix, sizes, max_keys):
        near = _places(docs, k).join(F.broadcast(block.drop("k")), "key")
        inside = near.filter((start >= 0) & (start + F.col("n") <= F.col("n_words")))
        same = inside.filter(F.slice("ws", start + 1, F.col("n")) == F.col("words")).select("doc_id", "row", start.alias("start"), "n", "window_id")
        hits = same if hits is None else hits.unionByName(same)
    return materialize(hits, "window-hits").join(words.select("window_id", "items"), "window_id").select("doc_id", "row", "start", "n", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 3) -> DataFrame:
    """Per row of ``docs``: doc_id, row, n_words, n_hit (words inside any occurring window), items (sorted distinct ids)."""
    hits = find_hits(docs, benchmark, window, shingle)
    # A document's places are bounded by its own length; the widest window at each start covers the rest.
    spots = hits.groupBy("doc_id", "row", "start").agg(F.max("n").alias("n"), F.flatten(F.collect_set("items")).alias("items"))
    per = spots.groupBy("doc_id", "row").agg(
        F.sort_array(F.collect_list(F.struct("start", "n"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        "spans",
        zero,
        lambda a, s: F.struct(
            F.greatest(a["end"], s["start"] + s["n"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), s["start"] + s["n"] - F.greatest(a["end"], s["start"]))).cast("long").alias("n"),
        ),
    )
    per = per.select("doc_id", "row", covered["n"].alias("n_hit"), "items")
    rows = docs.select("doc_id", text_key("text").alias("row"), count_words(F.col("text")).alias("n_words"))
    return null_safe(rows, per, ["doc_id", "row"], "left")


def contamination_digest(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    got = contamination(docs, benchmark, window)
    ids = F.coalesce(F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ","), F.lit(""))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return got.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without the rows in which any window occurs."""
    doc, row, mine = free_names(docs, "doc", "row", "mine")
    bad = find_hits(docs.select("doc_id", "text"), benchmark, window).select(F.col("doc_id").alias(doc), F.col("row").alias(row)).distinct()
    bad = broadcast_if_small(materialize(bad, "contaminated"), MAX_BAD)
    return docs.withColumn(mine, text_key("text")).join(bad, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(mine) == F.col(row)), "left_anti").select(*all_columns(docs))
