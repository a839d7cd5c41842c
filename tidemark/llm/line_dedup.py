"""Line dedup: lines that repeat across documents go, except in the largest doc_id that holds them.

Lines are normalised and hashed inside Arrow batches; only ``(hash, doc, positions)`` rows are shuffled. They are
range-partitioned by hash with a secondary sort by document, so one frequent line spreads over as many partitions as
it needs, and each partition streams its runs. Runs that touch a partition's edge, two a partition at most, are settled
together afterwards. The result is one zlib-compressed keep bitmap per document; the text is never shuffled unless the
bitmaps are too large to broadcast.

Defined cases: null text is one empty line (an empty string likewise); a doc_id that occurs in several rows counts as
one document when documents per line are counted, and all its rows keep the line if it is the largest; null doc_id
counts as one document, smaller than all others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions_for, text_key

_TRIM = b" \t\n\x0b\x0c\r"
NO_DOC = -(1 << 63)


def split_lines(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The stripped, A-Z lower-cased line; None if it has fewer than ``min_chars`` code points."""
    key = line.strip(_TRIM)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "surrogatepass")) < min_chars):
        return None
    return key.lower()


def _hashes(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    digest, unpack = hashlib.blake2b, struct.Struct("<qq").unpack
    for batch in batches:
        h1, h2, doc, row, pos = [], [], [], [], []
        for doc_id, key, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), batch[2].to_pylist(), strict=True):
            seen: dict[bytes, list[int]] = {}
            for i, line in enumerate(split_lines(text)):
                k = line_key(line, min_chars)
                if k is not None:
                    seen.setdefault(k, []).append(i)
            for k, at in seen.items():
                a, b = unpack(digest(k, digest_size=16).digest())
                h1.append(a)
                h2.append(b)
                pos.append(at)
            doc += [NO_DOC if doc_id is None else doc_id] * len(seen)
            row += [key] * len(seen)
        if h1:
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.array(pos, pa.list_(pa.int32()))],
                ["h1", "h2", "doc", "row", "pos"],
            )


_SORTED = "h1 long, h2 long, doc long, row long, pos array<int>"
_SEEN = "kind int, h1 long, h2 long, doc long, row long, pos array<int>"


def _runs(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Stream one sorted partition (hash, then doc descending).

    kind 0: rows to drop, settled here. kind 1: all rows of a run that touches the partition's first or last row, which
    may go on in the next partition. Only the current run's batch slices are held.
    """
    first = True

    def emit(table: pa.RecordBatch, edge: bool) -> pa.RecordBatch | None:
        """All rows of whole runs in ``table``; edge: it is one run at the partition's edge."""
        a, b, d = (table[i].to_numpy(zero_copy_only=False) for i in range(3))
        n = len(a)
        start = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        new_doc = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (d[1:] != d[:-1])].astype(np.int64)
        docs = np.add.reduceat(new_doc, start)
        length = np.diff(np.r_[start, n])
        top = d[start]
        if edge:
            take = np.arange(n)
            kind = np.full(n, 1, np.int32)
        else:
            take = np.flatnonzero(np.repeat(docs >= min_docs, length) & (d != np.repeat(top, length)))
            kind = np.zeros(len(take), np.int32)
        if not len(take):
            return None
        rows = table.take(pa.array(take))
        return pa.RecordBatch.from_arrays([pa.array(kind), *rows.columns], ["kind", "h1", "h2", "doc", "row", "pos"])

    def settle(rows: list[pa.RecordBatch], edge: bool) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        out = emit(whole, edge)
        if out is not None:
            yield out

    held: list[pa.RecordBatch] = []  # rows of the last run so far
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = batch[0].to_numpy(zero_copy_only=False), batch[1].to_numpy(zero_copy_only=False)
        if held and (held[-1][0][0].as_py() != a[0] or held[-1][1][0].as_py() != b[0]):
            yield from settle(held, first)
            first, held = False, []
        start = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        if len(start) == 1:
            held.append(batch)
            continue
        cut = int(start[1])
        if held or first:
            yield from settle([*held, batch.slice(0, cut)], first)
            first, held = False, []
        else:
            cut = 0
        if cut < start[-1]:
            yield from settle([batch.slice(cut, int(start[-1]) - cut)], False)
        held = [batch.slice(int(start[-1]))]
    if held:
        yield from settle(held, True)


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``(doc, row, keep)``: for each document that loses lines, the zlib-compressed bitmap of the lines that it keeps, up to the last one it loses.

    ``doc`` is doc_id (NO_DOC for null), ``row`` the hash of its text. Documents that are not listed keep all.
    """
    src = docs.select("doc_id", text_key("text").alias("row"), "text")
    lines = src.mapInArrow(lambda it: _hashes(it, min_chars), _SORTED)
    n = partitions_for(docs)
    ordered = lines.repartitionByRange(n, "h1", "h2", F.col("doc").desc(), "row").sortWithinPartitions("h1", "h2", F.col("doc").desc(), "row")
    seen = materialize(ordered.mapInArrow(lambda it: _runs(it, min_docs), _SEEN), "line-runs")
    settled = seen.filter("kind = 0").select("doc", "row", "pos")
    # At most two runs a partition touch an edge, so the verdicts are bounded by twice the partition count.
    edge_docs = seen.filter("kind = 1").select("h1", "h2", "doc").distinct()
    verdict = edge_docs.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("max_doc"))
    verdict = verdict.filter(F.col("n_docs") >= min_docs).select("h1", "h2", "max_doc")
    edges = seen.filter("kind = 1").join(F.broadcast(verdict), ["h1", "h2"]).filter("doc != max_doc").select("doc", "row", "pos")
    lost = settled.unionByName(edges).groupBy("doc", "row").agg(F.flatten(F.collect_list("pos")).alias("pos"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for p in batch[2].to_pylist():
                bits = np.ones(max(p) + 1, np.uint8)
                bits[p] = 0
                whole = np.r_[bits, np.ones(-len(bits) % 8, np.uint8)]
                maps.append(zlib.compress(np.packbits(whole).tobytes()))
            yield pa.RecordBatch.from_arrays([batch[0], batch[1], pa.array(maps, pa.binary())], ["doc", "row", "keep"])

    return lost.mapInArrow(pack, "doc long, row long, keep binary")


def apply_bitmap(text: str | None, keep: bytes | None) -> tuple[bytes, int, int]:
    """Kept text as UTF-8, number of lines, number of dropped lines."""
    lines = split_lines(text)
    if keep is None:
        return b"\n".join(lines), len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[: len(lines)]
    gone = np.zeros(len(lines), bool)
    gone[: len(bits)] = bits == 0
    return b"\n".join(x for x, g in zip(lines, gone, strict=True) if not g), len(lines), int(gone.sum())


def with_bitmaps(docs: DataFrame, maps: DataFrame, max_broadcast_mb: int = 64) -> DataFrame:
    """``docs`` with its ``__keep`` bitmap (null: all lines stay). The bitmaps are broadcast only if their summed size, which
    is measured first, is within ``max_broadcast_mb``; else both sides are shuffled."""
    maps = materialize(maps, "line-bitmaps")
    size = maps.agg((F.sum(F.length("keep") + 48)).alias("b")).first()["b"] or 0
    left = docs.withColumn("__doc", F.coalesce("doc_id", F.lit(NO_DOC))).withColumn("__row", text_key("text"))
    right = maps.select(F.col("doc").alias("__doc"), F.col("row").alias("__row"), F.col("keep").alias("__keep"))
    if size <= max_broadcast_mb << 20:
        right = F.broadcast(right)
    return left.join(right, ["__doc", "__row"], "left").drop("__doc", "__row")


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept)`` per row of ``docs``; ``kept`` is the remaining text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [apply_bitmap(t, d) for t, d in zip(batch[1].to_pylist(), batch[2].to_pylist(), strict=True)]
            cols = [batch[0], pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array([x[0].decode("utf-8", "surrogatepass") for x in out], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_lines", "n_dropped", "kept"])

    src = docs.select("doc_id", "text")
    marked = with_bitmaps(src, keep_bitmaps(src, min_chars, min_docs))
    return marked.select("doc_id", "text", "__keep").mapInArrow(cut, "doc_id long, n_lines long, n_dropped long, kept string")
