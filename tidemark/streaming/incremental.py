"""The scheduled run as an incremental stream."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.urls import canonical_url
from ..operators.history_index import HistoryIndex
from ..plans.run import Params, publish, run_batch
from ..runtime import scratch
from ..sources.store import read_history


def start_incremental(hits: DataFrame, pages: DataFrame, rules: DataFrame, history_path: str, checkpoint: str, params: Params, on_stats: Callable[[int, DataFrame], None] | None = None, index_path: str | None = None) -> StreamingQuery:
    """Run over what is new in the stream ``hits`` and append to the history; ends when the input is used up.

    What a batch writes besides goes at its end; ``on_stats`` has to read what it keeps. A batch that is tried again does not see its own first try: it reads the history without its batch id and then replaces that
    partition.

    With ``index_path`` of the history's texts only those of candidates are compared: what its articles are found by is kept there, batch by batch (:class:`HistoryIndex`). Batches that the index
    lacks are added first, an index that is not there is made; a batch that is tried again replaces its part of both.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        history = read_history(spark, history_path).filter((F.col("batch_id") != batch_id) | F.col("batch_id").isNull())
        with scratch(spark):
            index = None if index_path is None else HistoryIndex(spark, index_path)
            if index:
                index.sync(history)
            lookup = None if index is None else lambda rows: index.lookup(rows, history, batch_id)
            run = run_batch(batch, pages, history, rules, replace(params, batch_id=batch_id), lookup=lookup)
            publish(run, history_path)
            if index:
                index.add(read_history(spark, history_path).filter(F.col("batch_id") == batch_id), batch_id)
            if on_stats:
                on_stats(batch_id, run.stats)

    return hits.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedupe_stream(df: DataFrame, key: Column | str = "url", ts: str = "published_at", delay: str = "14 hours") -> DataFrame:
    """First arrival of each canonical URL within the watermark's delay."""
    url = canonical_url(key) if isinstance(key, str) else key
    return df.withColumn("canonical_url", url).withWatermark(ts, delay).dropDuplicatesWithinWatermark(["canonical_url"])


def first_in_order(df: DataFrame, order: Sequence[str], key: str = "url", ts: str = "published_at", delay: str = "14 hours", groups: int = 1024) -> DataFrame:
    """Of each canonical URL in the stream the row that stands first in ``order``, not the first to arrive; with ``canonical_url``.

    A key keeps its best row so far; an earlier one replaces it, until the watermark has passed the key's first time by ``delay``. Then the row is emitted and
    the key forgotten. Rows older than the watermark are late and go. Append mode.

    Keys are dealt to ``groups`` by hash and share a state there, so Python is called for groups, not for keys; a group has to fit a task, raise it with many millions of open keys.
    """
    keyed = df.withColumn("canonical_url", canonical_url(key)).filter(F.col(ts).isNotNull())
    names, out = keyed.columns, keyed.schema
    wait = int(pd.Timedelta(delay).total_seconds() * 1000)
    ranks = [names.index(c) for c in order]

    def best(_: tuple[int], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        held = pickle.loads(state.get[0]) if state.exists else {}
        done = [url for url, (_, until) in held.items() if until <= mark]  # expired before these rows came
        if done:
            yield pd.DataFrame([held.pop(url)[0] for url in done], columns=names)
        for frame in frames:
            frame = frame[frame["__ms"] >= mark]
            if frame.empty:
                continue
            frame = frame.assign(__ms=frame.groupby("canonical_url", dropna=False)["__ms"].transform("min") + wait)
            top = frame.sort_values(list(order), kind="stable").drop_duplicates("canonical_url")
            for url, until, row in zip(top["canonical_url"], top["__ms"].tolist(), zip(*(top[c].tolist() for c in names), strict=True), strict=True):
                now, end = held.get(url, (None, until))
                better = now is None or tuple(row[i] for i in ranks) < tuple(now[i] for i in ranks)
                held[url] = (row if better else now, min(end, until))
        if held:
            state.update((pickle.dumps(held),))
            state.setTimeoutTimestamp(max(min(until for _, until in held.values()), mark + 1))
        elif state.exists:
            state.remove()

    marked = keyed.withColumn("__ms", F.unix_millis(F.col(ts).cast("timestamp"))).withColumn("__group", F.pmod(F.xxhash64("canonical_url"), F.lit(groups)))
    return marked.withWatermark(ts, delay).groupBy("__group").applyInPandasWithState(best, out, "held binary", "append", GroupStateTimeout.EventTimeTimeout)


def slot_of(ts: Column | str, hours: Sequence[int] = (8, 20), zone: str = "UTC") -> Column:
    """Start of the run slot that a time falls into: the last of ``hours`` in ``zone`` (any spacing) at or before it, as a timestamp."""
    hs = sorted(hours)
    local = F.from_utc_timestamp(F.col(ts) if isinstance(ts, str) else ts, zone)
    day, hour = F.date_trunc("day", local), F.hour(local)
    start = day - F.make_dt_interval(days=F.lit(1)) + F.make_dt_interval(hours=F.lit(hs[-1]))
    for h in hs:
        start = F.when(hour >= h, day + F.make_dt_interval(hours=F.lit(h))).otherwise(start)
    return F.to_utc_timestamp(start, zone)


def slot_counts(df: DataFrame, ts: str = "ts", hours: Sequence[int] = (8, 20), zone: str = "UTC") -> DataFrame:
    """``(slot, n)``: rows per run slot. Works on streams too (update mode)."""
    return df.groupBy(slot_of(ts, hours, zone).alias("slot")).agg(F.count("*").alias("n"))


def slot_counts_stream(df: DataFrame, ts: str = "ts", hours: Sequence[int] = (8, 20), zone: str = "UTC", late: str = "2 hours") -> DataFrame:
    """``(slot, n)`` of a stream in append mode, for slots of any spacing: a slot is emitted once, when rows of a slot that starts ``late`` after its end have come;
    what comes for it later is dropped.

    Slots are event times themselves: the watermark is on them, as far back as the longest slot (and an hour, where clocks change) and ``late``.
    """
    hs = sorted(set(hours))
    longest = max((b - a) % 24 or 24 for a, b in zip(hs, [*hs[1:], hs[0]], strict=True))
    marked = df.withColumn("slot", slot_of(ts, hs, zone)).withWatermark("slot", f"{longest + 1} hours {late}")
    return marked.groupBy("slot").agg(F.count("*").alias("n"))


def window_counts(df: DataFrame, ts: str = "ts", start: str = "8 hours") -> DataFrame:
    """The same for two runs 12 hours apart, as a tumbling window with a watermark-friendly key."""
    return df.groupBy(F.window(ts, "12 hours", startTime=start).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("slot"), "n")
