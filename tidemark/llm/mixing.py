"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every source gets a target number of words; its documents are then taken ``target / source_size`` times on average, as a whole number of copies each. The
fractional parts are settled by the pivotal method on words: two documents exchange expected words, in a random direction
that keeps every expectation, until one of them has a whole number of copies; the other meets the next one. This runs as a fold
inside random chunks of about ``CHUNK`` documents, largest first, and each chunk's one open document goes up a reduction
tree of further chunks until one is left per source, which is rounded. Expected words are conserved at each exchange, so a
source misses its target by at most half of that one document. All random numbers are hashes of the seed and ids: reruns agree.

Defined cases: null text has size 0, which is always taken 0 words; null source is a source, last in order; rows equal in id, source and
text are rounded as one unit and all get the same copies; null doc_id is an id; an empty table gives no rows; if all sizes are 0, all targets
are; other columns are carried along by :func:`mix` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import all_columns, broadcast_if_small, free_names, materialize, null_safe, text_key

CHUNK = 200
WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
SEED = 20_11
#: Sources whose table is broadcast (at most about 100 bytes each); more are joined by a shuffle.
MAX_SOURCES = 200_000
#: Rows of a plan (about 40 bytes each) that are broadcast to repeat documents; with more, the documents are shuffled.
MAX_PLAN = 1_000_000
#: Sources that one task adds up.
MAX_RUN = 1_000_000

_OPEN = "struct<d:bigint,r:bigint,u:double,p:double>"
_DONE = "array<struct<d:bigint,r:bigint,t:int>>"


def size_of(text: Column) -> Column:
    """Words of a text: runs of anything but space and \\t to \\r."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, under each name, the sum of a column over all rows before. Range partitions of at most about ``MAX_RUN`` rows are summed by
    themselves, and their totals, one row a partition, are added up in turn."""
    n = max(1, -(-df.count() // MAX_RUN))
    part = materialize(df.repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id()), "mix-run")
    here = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    totals = part.groupBy("__p").agg(*[F.sum(v).alias(f"__t_{k}") for k, v in sums.items()])
    base = totals.select("__p", *[F.coalesce(F.sum(f"__t_{k}").over(parts), F.lit(0)).alias(f"__b_{k}") for k in sums])
    out = part.join(F.broadcast(base), "__p")
    return out.withColumns({k: F.coalesce(F.sum(v).over(here), F.lit(0)) + F.col(f"__b_{k}") for k, v in sums.items()}).drop("__p", *[f"__b_{k}" for k in sums])


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``(source, source_size)`` to the same with ``target``: one row a source.

    Sources in code point order (null last) weigh ``weights`` in turn and share the sum of all sizes; no target exceeds
    ``max_copies`` times its source, and what is cut is shared again by weight. Sorting by the ratio at which a source
    is cut makes that a prefix sum instead of a loop.
    """
    ranked = _running(sizes, [F.col("source").asc_nulls_last()], {"place": F.lit(1)})
    turn = F.pmod(F.col("place"), F.lit(len(weights))).cast("int")
    ranked = ranked.withColumn("w", F.get(F.array(*[F.lit(float(x)) for x in weights]), turn)).withColumn("cap", (F.col("source_size") * max_copies).cast("double")).drop("place")
    total = ranked.agg(F.sum(F.col("source_size").cast("double")).alias("n"), F.sum("w").alias("w")).first()
    levels = _running(ranked, [F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()], {"cap_before": F.col("cap"), "w_before": F.col("w")})
    levels = levels.withColumn("level", (F.lit(total["n"]) - F.col("cap_before")) / (F.lit(total["w"]) - F.col("w_before"))).withColumn("cut", F.col("level") * F.col("w") >= F.col("cap"))
    levels = materialize(levels.drop("cap_before", "w_before"), "mix-levels")
    first = levels.filter(~F.col("cut")).agg(F.min(F.struct((F.col("cap") / F.col("w")).alias("o"), F.col("level").alias("level")))["level"].alias("level")).first()["level"]
    target = F.when(F.col("cut"), F.col("cap")).otherwise(F.lit(first).cast("double") * F.col("w"))
    return levels.withColumn("target", target).select("source", "source_size", "target")


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)).cast("double") / float(1 << 53)


def _meet(cur: Column, nxt: Column, level: int, seed: int) -> Column:
    """One pivotal exchange of expected words; gives ``(open, done)``: what stays fractional, and what was settled."""
    a1, a2 = (1 - cur["p"]) * cur["u"], nxt["p"] * nxt["u"]  # words that cur can gain from nxt
    b1, b2 = cur["p"] * cur["u"], (1 - nxt["p"]) * nxt["u"]  # words that cur can give to nxt
    a, b = F.least(a1, a2), F.least(b1, b2)
    up = _uniform(F.lit(seed), F.lit(level), cur["d"], cur["r"], nxt["d"], nxt["r"]) * (a + b) < b

    def is_open(x: Column, p: Column) -> Column:
        return F.struct(x["d"].alias("d"), x["r"].alias("r"), x["u"].alias("u"), p.alias("p"))

    def is_done(x: Column, t: int) -> Column:
        return F.struct(x["d"].alias("d"), x["r"].alias("r"), F.lit(t).alias("t"))

    none = F.lit(None).cast(_OPEN)

    def move(one: Column, two: Column, lo: Column, top: int) -> Column:
        # cur is settled at ``top`` if ``one`` binds, nxt at 1 - top if ``two`` does
        shift = lo if top else -lo
        return (
            F.when(one < two, F.struct(is_open(nxt, nxt["p"] - shift / nxt["u"]).alias("open"), F.array(is_done(cur, top)).alias("done")))
            .when(two < one, F.struct(is_open(cur, cur["p"] + shift / cur["u"]).alias("open"), F.array(is_done(nxt, 1 - top)).alias("done")))
            .otherwise(F.struct(none.alias("open"), F.array(is_done(cur, top), is_done(nxt, 1 - top)).alias("done")))
        )

    return F.when(up, move(a1, a2, a, 1)).otherwise(move(b1, b2, b, 0))


def _fold(units: DataFrame, level: int, seed: int) -> DataFrame:
    """Units ``(source, salt, d, r, u, p)`` to one row a chunk: ``(source, open, done)``."""
    chunks = units.groupBy("source", "salt").agg(F.sort_array(F.collect_list(F.struct((-F.col("u")).alias("o"), "d", "r", "u", "p"))).alias("xs"))
    start = F.struct(F.lit(None).cast(_OPEN).alias("open"), F.array().cast(_DONE).alias("done"))

    def step(acc: Column, x: Column) -> Column:
        nxt = F.struct(x["d"].alias("d"), x["r"].alias("r"), x["u"].alias("u"), x["p"].alias("p"))
        met = F.transform(F.array(_meet(acc["open"], nxt, level, seed)), lambda m: F.struct(m["open"].alias("open"), F.concat(acc["done"], m["done"]).alias("done")))
        return F.when(acc["open"].isNull(), F.struct(nxt.alias("open"), acc["done"].alias("done"))).otherwise(F.get(met, F.lit(0)))

    return chunks.select("source", F.aggregate("xs", start, step).alias("f")).select("source", "f.open", "f.done")


def round_copies(units: DataFrame, chunk: int = CHUNK, seed: int = SEED) -> DataFrame:
    """Units ``(source, d, r, u, p)``, 0 < p < 1 and u > 0 words, to ``(source, d, r, t)`` with t 0 or 1 and mean p."""
    counts = units.groupBy("source").agg(F.count("*").alias("n"))
    level, settled = 0, []
    while True:
        salts = F.ceil(F.col("n") / chunk).cast("long")
        sized = null_safe(units, broadcast_if_small(counts, MAX_SOURCES), ["source"], "inner")
        salted = sized.withColumn("salt", F.when(salts <= 1, F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "d", "r"), salts)))
        folded = materialize(_fold(salted, level, seed), f"mix-{level}")
        settled.append(folded.select("source", F.explode("done").alias("x")).select("source", "x.d", "x.r", "x.t"))
        units = folded.filter("open IS NOT NULL").select("source", "open.d", "open.r", "open.u", "open.p")
        counts = units.groupBy("source").agg(F.count("*").alias("n"))
        level += 1
        if (counts.agg(F.max("n").alias("m")).first()["m"] or 0) <= 1:
            break
    # The last open document of a source goes to the nearer whole number, so that the source misses by half of it at most.
    last = units.select("source", "d", "r", (F.col("p") >= 0.5).cast("int").alias("t"))
    for s in settled:
        last = last.unionByName(s)
    return last


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """``(doc_id, source, row, n_rows, size, source_size, target, copies)``: one row per distinct id, source and text."""
    rows = docs.select("doc_id", "source", text_key("text").alias("row"), size_of(F.col("text")).alias("size"))
    base = materialize(rows.groupBy("doc_id", "source", "row").agg(F.count("*").alias("n_rows"), F.first("size").alias("size")), "mix-sizes")
    totals = base.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size"))
    targets = materialize(source_targets(totals, weights, max_copies), "mix-targets")
    sized = null_safe(base, broadcast_if_small(targets, MAX_SOURCES), ["source"], "inner")
    mean = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sized = sized.withColumn("__least", F.least(F.floor(mean), F.lit(max_copies)).cast("long")).withColumn("__p", mean - F.floor(mean))
    units = sized.filter("__p > 0 AND size > 0").select("source", F.col("doc_id").cast("long").alias("d"), F.col("row").alias("r"), (F.col("size") * F.col("n_rows")).cast("double").alias("u"), F.col("__p").alias("p"))
    extra = round_copies(units, seed=seed).select("source", F.col("d").alias("doc_id"), F.col("r").alias("row"), "t")
    joined = null_safe(sized, extra, ["doc_id", "source", "row"], "left")
    return joined.withColumn("copies", F.col("__least") + F.coalesce("t", F.lit(0))).drop("__least", "__p", "t")


def mix_digest(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken."""
    plan = plan_mix(docs).withColumn("__again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """``docs`` with each row repeated by its copies (none: it goes)."""
    doc, source, row, mine, copies, again = free_names(docs, "doc", "source", "row", "mine", "copies", "again")
    plan = plan_mix(docs.select("doc_id", "source", "text"), weights, max_copies, seed).filter("copies > 0")
    plan = plan.select(F.col("doc_id").alias(doc), F.col("source").alias(source), F.col("row").alias(row), F.col("copies").alias(copies))
    plan = broadcast_if_small(materialize(plan, "mix-plan"), MAX_PLAN)
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & F.col("source").eqNullSafe(F.col(source)) & F.col(mine).eqNullSafe(F.col(row))
    kept = docs.withColumn(mine, text_key("text")).join(plan, same)
    return kept.withColumn(again, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*all_columns(docs))
