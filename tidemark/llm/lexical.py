"""Ranked lexical search: the best documents of each query by summed term weights, found through bit-sliced Bloom signatures.

1. One pass over the corpus counts what the weights need (documents, terms, documents of each query term) and writes the index: documents of like size share a
   block, and a block has one bitmap over its documents for each signature bit. A document sets the bits of its terms, and again for each of ``LEVELS`` that a term's
   count reaches, so the signature overestimates counts and never underestimates them.
2. A pass over the index adds up weights: a term is taken to be in the documents of the conjunction of its bitmaps, as often as its highest level allows. The
   sums are upper bounds. The ``top`` documents by upper bound are scored exactly; the last of them gives a score that a result has to reach.
3. A second pass over the index lists every document whose bound reaches it; these are scored exactly, and ranked. What is left out is provably lower.

Queries come in blocks of ``MAX_ITEMS``; a block's terms and weights go to all tasks. Terms are told apart by 64-bit hashes.

Defined cases: null and empty texts have no terms and are in no result; items without terms have none; rows equal in item_id and text are one item; rows of one
item_id with different texts are ranked one by one; repeated documents are ranked one by one, of equal scores by doc_id (null first); empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .common import in_blocks, materialize, text_key

TOP = 50
MAX_ITEMS = 1000
#: Bits of a signature for each of its elements, and bits that an element sets.
BITS, HASHES = 16, 5
#: Counts whose reaching is an element of its own.
LEVELS = (1, 2, 3, 4, 6, 10, 20)
#: Documents and elements of an index block.
BLOCK_DOCS, BLOCK_ELEMENTS = 2048, 1 << 19
NO_DOC = -(1 << 63)
_U = np.uint64
_SALT = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
INDEX = "kind int, bits int, doc array<long>, row array<long>, n array<int>, slices binary"


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each term of a batch."""
    low = tk.LOWER[data]
    words = tk.find_words(low, offsets, tk.ALNUM)
    return tk.hash_spans(low, words.start, words.end), words.doc


def term_counts(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash and count of each distinct term of a document, by document. Documents are told apart by the top 16 bits of the key, terms by 48 bits; two
    terms of a document that share them count as one, which can only raise counts."""
    key = doc.astype(_U) << _U(48) | h >> _U(16)
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.r_[len(key) > 0, key[1:] != key[:-1]])
    return doc[order][at], h[order][at], np.diff(np.r_[at, len(key)])


def spots(h: np.ndarray, level: int, bits: int) -> np.ndarray:
    """The bits of elements (term, level) in a signature of ``bits``, a row for each of ``HASHES``."""
    x = tk.mix((h >> _U(16)) * _SALT[level % len(_SALT)] + _U(level))
    step = (x >> _U(32)) | _U(1)
    return np.stack([((x + _U(i) * step) & _U(0xFFFFFFFF)) * _U(bits) >> _U(32) for i in range(HASHES)]).astype(np.int64)


class _Index:
    """Collects documents by size and cuts blocks."""

    def __init__(self) -> None:
        self.open: dict[int, list[tuple[int, int, int, np.ndarray, np.ndarray]]] = {}

    def add(self, doc: int, row: int, n: int, h: np.ndarray, count: np.ndarray) -> pa.RecordBatch | None:
        elements = sum(int((count >= x).sum()) for x in LEVELS)
        size = max(32, 1 << (elements - 1).bit_length())
        block = self.open.setdefault(size, [])
        block.append((doc, row, n, h, count))
        return self.cut(size) if len(block) >= BLOCK_DOCS or len(block) * size >= BLOCK_ELEMENTS else None

    def cut(self, size: int) -> pa.RecordBatch:
        block = self.open.pop(size)
        bits, docs = BITS * size, len(block)
        width = -(-docs // 8) * 8
        grid = np.zeros(bits * width, bool)
        of = np.repeat(np.arange(docs), [len(x[3]) for x in block])
        h, count = np.concatenate([x[3] for x in block]), np.concatenate([x[4] for x in block])
        for level, least in enumerate(LEVELS):
            some = count >= least
            for at in spots(h[some], level, bits):
                grid[at * width + of[some]] = True
        slices = np.packbits(grid).tobytes()
        column = lambda i, kind: pa.array([[x[i] for x in block]], pa.list_(kind))
        return pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([bits], pa.int32()), column(0, pa.int64()), column(1, pa.int64()), column(2, pa.int32()), pa.array([slices], pa.binary())], ["kind", "bits", "doc", "row", "n", "slices"])


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch[0].cast(pa.int64()).fill_null(NO_DOC).to_numpy(zero_copy_only=False), batch[1].to_numpy(zero_copy_only=False)


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int]]:
    """Pieces of a batch of so few documents that :func:`term_counts` can tell them apart."""
    for a, b in tk.pieces(batch[column]):
        for x in range(a, b, 1 << 15):
            yield x, min(b, x + (1 << 15))


def _scan(batches: Iterator[pa.RecordBatch], wanted: np.ndarray, build: bool) -> Iterator[pa.RecordBatch]:
    """(doc_id, row, text) to index blocks (kind 1) and one row of counts a task (kind 0): documents, terms, and documents of each wanted term."""
    index, n_docs, n_terms, df = _Index(), 0, 0, np.zeros(len(wanted), np.int64)
    for batch in batches:
        docs, rows = _keys(batch)
        for a, b in _parts(batch, 2):
            h, owner = term_hashes(*tk.buffers(batch[2].slice(a, b - a)))
            doc, term, count = term_counts(h, owner)
            if len(wanted):
                at = np.minimum(np.searchsorted(wanted, term), len(wanted) - 1)
                df += np.bincount(at[wanted[at] == term], minlength=len(wanted))
            first = np.searchsorted(doc, np.arange(b - a + 1))
            n = np.bincount(owner, minlength=b - a)
            n_docs, n_terms = n_docs + int((n > 0).sum()), n_terms + len(h)
            if build:
                for i in np.flatnonzero(n).tolist():
                    lo, hi = first[i], first[i + 1]
                    if (block := index.add(int(docs[a + i]), int(rows[a + i]), int(n[i]), term[lo:hi], count[lo:hi])) is not None:
                        yield block
    for size in list(index.open):
        yield index.cut(size)
    counts = pa.array([[n_docs, n_terms, *df.tolist()]], pa.list_(pa.int64()))
    empty = pa.array([[]], pa.list_(pa.int32()))
    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([0], pa.int32()), counts, pa.array([[]], pa.list_(pa.int64())), empty, pa.array([b""], pa.binary())], ["kind", "bits", "doc", "row", "n", "slices"])
    tk.trim()


@dataclass(frozen=True)
class Queries:
    """A block of items: their distinct term hashes, sorted, with weights; each item's terms as places in these."""

    terms: np.ndarray
    weights: np.ndarray
    flat: np.ndarray
    starts: np.ndarray
    docs: int  # N
    words: int  # L

    @property
    def items(self) -> int:
        return len(self.starts) - 1

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """What a document's length adds below a term's count."""
        return 50 + (50 * n.astype(np.int64) * self.docs) // self.words

    def gain(self, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        return 1_000_000_000 * tf // np.maximum(1000 * tf + 20 * m, 1)

    def sums(self, of_terms: np.ndarray) -> np.ndarray:
        """Rows of terms to rows of items."""
        out = np.zeros((self.items, of_terms.shape[1]), np.int64)
        some = np.flatnonzero(np.diff(self.starts))
        if len(some):
            out[some] = np.add.reduceat(of_terms[self.flat], self.starts[some], axis=0)
        return out


def bounds(q: Queries, bits: int, n: np.ndarray, slices: bytes) -> np.ndarray:
    """Upper bound of each item's score (rows) for each document of an index block (columns)."""
    docs = len(n)
    grid = np.frombuffer(slices, np.uint8).reshape(bits, -1)
    reach = np.zeros((len(q.terms), docs), np.int8)
    some = np.arange(len(q.terms))
    for level in range(len(LEVELS)):
        at = spots(q.terms[some], level, bits)
        held = grid[at[0]]
        for x in at[1:]:
            held &= grid[x]
        here = np.unpackbits(held, axis=1, count=docs).astype(bool)
        if level:
            here &= reach[some] == level
        reach[some] += here
        some = some[here.any(1)]
        if not len(some):
            break
    most = np.array([0, *[x - 1 for x in LEVELS[1:]], 0])[:, None] + np.zeros((1, docs), np.int64)
    most[-1] = n
    gains = q.gain(np.minimum(most, n), q.lengths(n)[None, :])
    out = np.zeros((q.items, docs), np.int64)
    step = max(1, (1 << 22) // max(1, len(q.flat)))
    for a in range(0, docs, step):
        cut = slice(a, a + step)
        out[:, cut] = q.sums(np.take_along_axis(gains[:, cut], reach[:, cut].astype(np.int64), 0) * q.weights[:, None])
    return out


def _blocks(batches: Iterator[pa.RecordBatch], q: Queries) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            doc, row, n = (batch[k][i].values.to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            yield doc, row, bounds(q, batch[0][i].as_py(), n, batch[4][i].as_buffer())


def _best(batches: Iterator[pa.RecordBatch], q: Queries, top: int) -> Iterator[pa.RecordBatch]:
    """The ``top`` documents of each item by upper bound, in one task: (item, doc, row, bound)."""
    held = [np.zeros((q.items, 0), np.int64) for _ in range(3)]
    for doc, row, bound in _blocks(batches, q):
        wide = lambda x, b=bound: np.broadcast_to(x, b.shape)
        held = [np.hstack([a, b]) for a, b in zip(held, (bound, wide(doc), wide(row)), strict=True)]
        if held[0].shape[1] > top:
            keep = np.argpartition(-held[0], top - 1, axis=1)[:, :top]
            held = [np.take_along_axis(x, keep, 1) for x in held]
    item, at = np.nonzero(held[0] > 0)
    if len(item):
        yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), *[pa.array(held[k][item, at]) for k in (1, 2, 0)]], ["item", "doc", "row", "bound"])
    tk.trim()


def _reaching(batches: Iterator[pa.RecordBatch], q: Queries, least: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(doc, row, items): documents with the items whose least score their bound reaches."""
    for doc, row, bound in _blocks(batches, q):
        at, item = np.nonzero((bound >= least[:, None]).T)
        if len(at):
            start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[start, len(at)].astype(np.int32)), pa.array(item.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(doc[at[start]]), pa.array(row[at[start]]), lists], ["doc", "row", "items"])
    tk.trim()


def _exact(batches: Iterator[pa.RecordBatch], q: Queries, least: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, items) to (item, doc_id, score), of scores that reach ``least``."""
    for batch in batches:
        for a, b in _parts(batch, 1):
            h, owner = term_hashes(*tk.buffers(batch[1].slice(a, b - a)))
            n = np.bincount(owner, minlength=b - a)
            m = q.lengths(n)
            at = np.minimum(np.searchsorted(q.terms, h), len(q.terms) - 1)
            known = q.terms[at] == h
            pair, tf = np.unique(owner[known] * len(q.terms) + at[known], return_counts=True)
            doc, term = np.divmod(pair, len(q.terms))
            gain = np.zeros(len(q.terms), np.int64)
            first = np.searchsorted(doc, np.arange(b - a + 1))
            items, ids, scores = [], [], []
            for i, wanted in enumerate(batch[2].slice(a, b - a)):
                x = slice(first[i], first[i + 1])
                gain[term[x]] = q.weights[term[x]] * q.gain(tf[x], m[i])
                for item in wanted.values.to_pylist():
                    score = int(gain[q.flat[q.starts[item] : q.starts[item + 1]]].sum())
                    if score >= least[item]:
                        items.append(item)
                        ids.append(a + i)
                        scores.append(score)
                gain[term[x]] = 0
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int32()), batch[0].take(pa.array(ids, pa.int64())), pa.array(scores, pa.int64())], ["item", "doc_id", "score"])
    tk.trim()


def _score(docs: DataFrame, pairs: DataFrame, q: Queries, least: np.ndarray, max_broadcast_mb: int) -> DataFrame:
    """Exact scores of ``pairs`` (doc, row, items): broadcast to the texts if their bytes, added up first, are within the limit; else both are shuffled."""
    size = pairs.agg(F.sum(F.size("items") * 4 + 48).alias("b")).first()["b"] or 0
    pairs = F.broadcast(pairs) if size <= max_broadcast_mb << 20 else pairs
    left = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)).alias("doc"), text_key("text").alias("row"), "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return left.join(pairs, ["doc", "row"]).select("doc_id", "text", "items").mapInArrow(lambda it: _exact(it, q, least), f"item int, doc_id {kind}, score long")


def _ranked(scores: DataFrame, top: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first()))
    return scores.withColumn("rank", place).filter(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, max_broadcast_mb: int = 64) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` documents ``(doc_id, text)`` with the highest score above 0 for each of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    src = docs.select("doc_id", text_key("text").alias("row"), "text")
    found, index = [], None
    wanted = items.select("item_id", "text").filter("length(text) > 0").distinct()
    for block in in_blocks(wanted.withColumn("deal", F.xxhash64("item_id", "text")), "deal", MAX_ITEMS):
        # A block of queries, at most MAX_ITEMS rows.
        rows = block.select("item_id", "text").collect()
        h, owner = term_hashes(*tk.buffers(pa.array([r["text"] for r in rows], pa.string())))
        owner, h, _ = term_counts(h, owner)
        terms, flat = np.unique(h, return_inverse=True)
        scan = materialize(src.mapInArrow(lambda it, t=terms, b=index is None: _scan(it, t, b), INDEX), "signatures")
        index = scan.filter("kind = 1").select("bits", "doc", "row", "n", "slices") if index is None else index
        # One row of counts for each task; summed by place.
        each = scan.filter("kind = 0").select(F.posexplode("doc").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x"))
        counts = np.zeros(len(terms) + 2, np.int64)
        for r in each.collect():
            counts[r["k"]] = r["x"]
        if not counts[1]:
            continue
        weights = np.array([math.floor(1000 * math.log((2 * int(counts[0]) + 2) / (2 * int(x) + 1))) if x else 0 for x in counts[2:]], np.int64)
        q = Queries(terms, weights, flat, np.searchsorted(owner, np.arange(len(rows) + 1)), int(counts[0]), int(counts[1]))
        near = index.mapInArrow(lambda it, q=q: _best(it, q, top), "item int, doc long, row long, bound long")
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("bound").desc(), "doc", "row"))
        near = near.withColumn("place", place).filter(F.col("place") <= top).groupBy("doc", "row").agg(F.collect_set("item").alias("items"))
        some = _score(docs, materialize(near, "search-first"), q, np.ones(len(rows), np.int64), max_broadcast_mb)
        last = _ranked(some, top).filter(F.col("rank") == top).select("item", "score").collect()
        least = np.ones(len(rows), np.int64)
        for r in last:
            least[r["item"]] = r["score"]
        reaching = index.mapInArrow(lambda it, q=q, x=least: _reaching(it, q, x), "doc long, row long, items array<int>").dropDuplicates(["doc", "row"])
        exact = _score(docs, materialize(reaching, "search-open"), q, least, max_broadcast_mb)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        found.append(_ranked(exact, top).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    if not found:
        kinds = [t.schema[c].dataType.simpleString() for t, c in ((items, "item_id"), (docs, "doc_id"))]
        return spark.createDataFrame([], f"item_id {kinds[0]}, rank int, doc_id {kinds[1]}, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
