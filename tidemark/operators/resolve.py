"""Greedy duplicate resolution and the one outcome of each row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import title_key
from ..runtime import materialize

STATUSES = ("published", "duplicate", "policy", "too_short", "failed")


def edge_keys(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain edges ``(earlier, later)`` as members and watchers: each earlier row is a key of its own."""
    key = F.col("earlier").cast("string").alias("key")
    return edges.select(key, F.col("earlier").alias("id")).distinct(), edges.select(key, F.col("later").alias("id")).distinct()


def resolve_greedy(rows: DataFrame, members: DataFrame, watchers: DataFrame, unsure: DataFrame | None = None) -> DataFrame:
    """``(id, is_dup, kept, is_open)`` for rows ``(id, ord, eligible, in_history)``.

    Rows are taken by ``ord``; a row is a duplicate if it is in the history or watches a key of an earlier kept row, and only eligible rows are
    kept and so make duplicates of later ones. Each round settles the undecided rows whose keys have no earlier undecided member: the rounds number the longest
    chain. A key is reduced to its first kept and first undecided member before it meets its watchers. Rows ``(id)`` of ``unsure`` may watch keys that
    are not known yet: they can be found duplicates but are not kept, and they stay open with those that wait for them; without ``unsure`` no row does.
    """
    order = rows.select("id", "ord")
    inside = members.join(rows.filter("eligible").select("id", "ord"), "id").select("key", "id", "ord")
    inside = materialize(inside, "greedy-members")
    watch = materialize(watchers.join(order, "id").select("key", "id", "ord"), "greedy-watchers")
    doubt = rows.select("id").limit(0) if unsure is None else unsure
    sure = rows.join(doubt.withColumn("unsure", F.lit(True)), "id", "left")
    state = materialize(sure.select("id", "eligible", F.coalesce("unsure", F.lit(False)).alias("unsure"), F.when(F.col("in_history"), F.lit(-1)).otherwise(F.lit(0)).alias("state")), "greedy-0")
    n, left = 0, -1
    while left and (now := state.filter("state = 0").count()) != left:
        if not now:
            break
        n, left = n + 1, now
        first = inside.join(state.select("id", "state"), "id").filter("state >= 0").groupBy("key").agg(
            F.min(F.when(F.col("state") == 1, F.col("ord"))).alias("kept"), F.min(F.when(F.col("state") == 0, F.col("ord"))).alias("open")
        )
        seen = watch.join(first, "key").groupBy("id").agg(F.max(F.col("kept") < F.col("ord")).alias("by_kept"), F.max(F.col("open") < F.col("ord")).alias("waits"))
        new = (
            F.when(F.col("state") != 0, F.col("state"))
            .when(F.coalesce("by_kept", F.lit(False)), -1)
            .when(F.coalesce("waits", F.lit(False)) | F.col("unsure"), 0)
            .otherwise(F.when(F.col("eligible"), 1).otherwise(2))
        )
        state = materialize(state.join(seen, "id", "left").select("id", "eligible", "unsure", new.alias("state")), f"greedy-{n}")
    return state.select("id", (F.col("state") == -1).alias("is_dup"), (F.col("state") == 1).alias("kept"), (F.col("state") == 0).alias("is_open"))


def title_dups(rows: DataFrame) -> DataFrame:
    """``(id, is_dup)`` for rows ``(id, ord, title, eligible)``: an earlier eligible row has the same title key.

    The first eligible row of a key is kept, so it alone decides: one aggregation and a join, no ordering of the whole group.
    """
    keyed = rows.withColumn("__key", title_key("title"))
    first = keyed.filter("eligible AND __key != ''").groupBy("__key").agg(F.min("ord").alias("__first"))
    return keyed.join(first, "__key", "left").select("id", F.coalesce(F.col("__first") < F.col("ord"), F.lit(False)).alias("is_dup"))


def classify(rows: DataFrame, resolve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(id, status)``: the first that holds of failed (page missing), duplicate, too_short, policy, failed (draft), published.

    ``rows`` is ``(id, ord, page_missing, in_history, too_short, policy, draft_failed)``; ``resolve`` gives ``(id, is_dup)`` of ``(id, ord, eligible, in_history)``.
    """
    eligible = ~F.col("page_missing") & ~F.col("too_short") & ~F.col("policy") & ~F.col("draft_failed")
    settled = resolve(rows.select("id", "ord", eligible.alias("eligible"), "in_history"))
    status = F.when(F.col("page_missing"), "failed").when(F.col("is_dup"), "duplicate").when(F.col("too_short"), "too_short").when(F.col("policy"), "policy").when(F.col("draft_failed"), "failed").otherwise("published")
    return rows.join(settled, "id").select("id", status.alias("status"))


def run_stats(outcomes: DataFrame) -> DataFrame:
    """One row of six counts over ``(status)``."""
    count = lambda s: F.count_if(F.col("status") == s)
    return outcomes.agg(
        F.count("*").alias("total_candidates"),
        count("published").alias("published"),
        count("duplicate").alias("skipped_duplicate"),
        count("policy").alias("skipped_policy"),
        count("too_short").alias("skipped_too_short"),
        count("failed").alias("failed"),
    )
