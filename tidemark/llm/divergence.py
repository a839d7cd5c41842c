"""Divergence of sources: how far the term distributions of the sources of a language are apart, and which terms tell a source from its language.

1. Terms are counted inside the tasks and added up by (lang, source, term); a language keeps the terms of at least ``min_docs`` of its documents.
2. The kept terms of a language get ids in blocks of ``BLOCK`` by their hash. In a block each source is a segment tree over the ids with counts at its leaves. Trees are
   hash-consed: subtrees of equal counts are one node, whichever source they are of.
3. Two sources are compared by walking both trees at once, all pairs of sources of a block together and level by level: each distinct pair of nodes (with the
   denominators of its sources) is priced once, and its price is shared by all that meet it. The blocks of a pair add up.

Sources meet in chunks of ``CHUNK``, so a task holds ``CHUNK`` sources of two chunks and ``BLOCK`` terms at most. All arithmetic is in whole numbers, beyond 64 bits where it has to be.

Defined cases: null text, lang and source are ''; a document counts as many times as its row is there; groups without terms are compared as all others; a
language without kept terms gives pairs of value 0 and no terms; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .common import materialize

MIN_DOCS = 30
TOP_TERMS = 50
#: Terms of a block of trees, and sources of a chunk.
BLOCK, CHUNK = 256, 64
#: Counts that a task holds before it passes them on.
HELD = 1 << 20
SCALE, PRIOR = 1_000_000_000, 5
_U = np.uint64
#: Letters and all that is outside ASCII.
LETTERS = tk.byte_set((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_COUNTS = "lang string, source string, term string, n long, docs long"


class _Counter:
    """Counts of (group, term) in one task."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.names: dict[int, bytes] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def group(self, lang: str, source: str) -> int:
        return self.groups.setdefault((lang, source), len(self.groups))

    def add(self, group: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
        """``group`` of each document of a piece."""
        low = tk.LOWER[data]
        words = tk.find_words(low, offsets, LETTERS)
        h = tk.hash_spans(low, words.start, words.end)
        order = np.lexsort((h, words.doc))
        doc, term = words.doc[order], h[order]
        at = np.flatnonzero(np.r_[len(term) > 0, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])])
        count = np.diff(np.r_[at, len(term)])
        one, where = np.unique(term[at], return_index=True)
        spot = order[at[where]]
        for x, s, e in zip(one.tolist(), words.start[spot].tolist(), words.end[spot].tolist(), strict=True):
            if x not in self.names:
                self.names[x] = low[s:e].tobytes()
        self.parts.append(self._sum(group[doc[at]], term[at], count, np.ones(len(at), np.int64)))
        self.size += len(self.parts[-1][0])

    @staticmethod
    def _sum(group: np.ndarray, term: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
        if not len(group):
            return (group, term, *values)
        order = np.lexsort((term, group))
        g, t = group[order], term[order]
        at = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (t[1:] != t[:-1])])
        return (g[at], t[at], *[np.add.reduceat(x[order], at) for x in values])

    def pack(self) -> None:
        whole = self._sum(*[np.concatenate(x) for x in zip(*self.parts, strict=True)]) if self.parts else ()
        self.parts, self.size = ([whole] if whole else []), len(whole[0]) if whole else 0

    def flush(self) -> Iterator[pa.RecordBatch]:
        self.pack()
        if self.size:
            group, term, n, docs = self.parts[0]
            keys = list(self.groups)
            for a in range(0, len(group), 1 << 16):
                x = slice(a, a + (1 << 16))
                of = [keys[g] for g in group[x].tolist()]
                names = [self.names[t].decode("utf-8", "surrogatepass") for t in term[x].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in of], pa.string()), pa.array([k[1] for k in of], pa.string()), pa.array(names, pa.string()), pa.array(n[x]), pa.array(docs[x])], ["lang", "source", "term", "n", "docs"])
        self.parts, self.size, self.names = [], 0, {}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to counts of terms, added up in the task, and one row without a term for each group."""
    held = _Counter()
    for batch in batches:
        group = np.array([held.group(*x) for x in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True)], np.int64)
        for a, b in tk.pieces(batch[2]):
            held.add(group[a:b], *tk.buffers(batch[2].slice(a, b - a)))
            if held.size > HELD:
                held.pack()
                if held.size > HELD // 2:
                    yield from held.flush()
    yield from held.flush()
    if held.groups:
        zero = pa.array([0] * len(held.groups), pa.int64())
        yield pa.RecordBatch.from_arrays([*[pa.array([k[i] for k in held.groups], pa.string()) for i in (0, 1)], pa.nulls(len(held.groups), pa.string()), zero, zero], ["lang", "source", "term", "n", "docs"])
    tk.trim()


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * kept)), exactly."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(count + PRIOR), wide(total + PRIOR * kept)) + 1


def _shares(count: np.ndarray, below: np.ndarray) -> np.ndarray:
    """The same for arrays; whole numbers of any size where 64 bits may not do. A count below 0 marks an unused id."""
    if len(count) and int(count.max()) >= (1 << 62) // SCALE:
        return np.array([0 if c < 0 else 1 + SCALE * (c + PRIOR) // d for c, d in zip(count.tolist(), below.tolist(), strict=True)], object)
    return np.where(count < 0, 0, 1 + SCALE * (count + PRIOR) // np.maximum(below, 1))


class Trees:
    """Segment trees of several sources over the same ids, hash-consed: a node is known by its children's numbers, a leaf by its count."""

    def __init__(self, counts: np.ndarray) -> None:
        """``counts``: a row for each source, a column for each id."""
        size = max(1, 1 << (counts.shape[1] - 1).bit_length())
        padded = np.full((counts.shape[0], size), -1, np.int64)
        padded[:, : counts.shape[1]] = counts
        self.leaf, node = np.unique(padded, return_inverse=True)
        node = node.reshape(padded.shape)
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []
        width = len(self.leaf)
        while node.shape[1] > 1:
            key, new = np.unique(node[:, ::2] * width + node[:, 1::2], return_inverse=True)
            self.left.append(key // width)
            self.right.append(key % width)
            node, width = new.reshape(node.shape[0], -1), len(key)
        self.roots = node[:, 0]

    def distances(self, a: np.ndarray, b: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, int]:
        """Summed differences of shares between sources ``a`` and ``b``, pair by pair; ``below`` has each source's denominator. Also the pairs of nodes priced."""
        kinds, of = np.unique(below, return_inverse=True)
        k = len(kinds)
        pairs = np.stack([self.roots[a], self.roots[b], of[a], of[b]])
        back: list[np.ndarray] = []
        priced = 0

        def distinct(p: np.ndarray, width: int) -> np.ndarray:
            key, where = np.unique(((p[0] * width + p[1]) * k + p[2]) * k + p[3], return_inverse=True)
            back.append(where)
            rest, db = np.divmod(key, k)
            rest, da = np.divmod(rest, k)
            return np.stack([rest // width, rest % width, da, db])

        pairs = distinct(pairs, len(self.left[-1]) if self.left else len(self.leaf))
        for depth in range(len(self.left) - 1, -1, -1):
            priced += pairs.shape[1]
            sides = [np.stack([child[pairs[0]], child[pairs[1]], pairs[2], pairs[3]]) for child in (self.left[depth], self.right[depth])]
            pairs = distinct(np.concatenate(sides, axis=1), len(self.left[depth - 1]) if depth else len(self.leaf))
        priced += pairs.shape[1]
        value = np.abs(_shares(self.leaf[pairs[0]], kinds[pairs[2]]) - _shares(self.leaf[pairs[1]], kinds[pairs[3]]))
        for where in reversed(back[1:]):
            both = value[where]
            value = both[: len(both) // 2] + both[len(both) // 2 :]
        return value[back[0]], priced


def _compare(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows (lang, block, x, y, source, chunk, below, term, n, terms) of two chunks of sources in a block to (lang, source, item, value), both ways of each pair."""
    names, source = np.unique(rows["source"].to_numpy(object), return_inverse=True)
    first = np.unique(source, return_index=True)[1]
    below, chunk = rows["below"].to_numpy(np.int64)[first], rows["chunk"].to_numpy()[first]
    real = rows["term"].notna().to_numpy()
    terms, at = np.unique(rows["term"].to_numpy(object)[real], return_inverse=True)
    # Terms of the block that only sources of other chunks have are counts of zero here.
    counts = np.zeros((len(names), int(rows["terms"].max())), np.int64)
    counts[source[real], at] = rows["n"].to_numpy(np.int64)[real]
    a, b = np.triu_indices(len(names), 1)
    x, y = rows["x"].iloc[0], rows["y"].iloc[0]
    ours = (chunk[a] != chunk[b]) if x != y else np.ones(len(a), bool)
    a, b = a[ours], b[ours]
    value, _ = Trees(counts).distances(a, b, below) if len(a) else (np.zeros(0, np.int64), 0)
    both = lambda p, q: np.concatenate([names[p], names[q]])
    return pd.DataFrame({"lang": rows["lang"].iloc[0], "source": both(a, b), "item": both(b, a), "value": np.concatenate([value, value]).astype(np.int64)})


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` for ``docs`` (text, lang, source): part ``pair`` has each other source of the language, part ``term`` the ``top``
    terms that a source has more of than its language."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    each = docs.select(text("lang"), text("source"), text("text")).mapInArrow(_count, _COUNTS)
    counts = materialize(each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    groups = counts.filter("term IS NULL").select("lang", "source")
    lang = counts.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).drop("docs")
    kept = materialize(counts.filter("term IS NOT NULL").drop("docs").join(lang, ["lang", "term"]), "kept-terms")
    # Totals of a language come from those of its groups; V from each term's row in its language.
    vocabulary = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("kept"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(vocabulary, "lang", "left").na.fill(0, ["total", "kept"])
    per_lang = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count("*").alias("sources"))
    groups = materialize(groups.join(per_lang, "lang"), "source-groups")
    chunks = F.ceil(F.col("sources") / CHUNK).cast("int")
    blocks = F.ceil(F.col("kept") / BLOCK).cast("int")
    dealt = groups.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("source"), F.col("chunks")).cast("int")).withColumn("blocks", blocks).withColumn("below", F.col("total") + PRIOR * F.col("kept"))
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    # Every group is in every block of its language, with or without terms there; each chunk meets each.
    keys = ["lang", "source", "chunk", "chunks", "below"]
    sizes = kept.select("lang", "term").distinct().join(groups.select("lang", blocks.alias("blocks")).distinct(), "lang").groupBy("lang", block.alias("block")).agg(F.count("*").alias("terms"))
    bare = dealt.join(sizes, "lang").select(*keys, "block", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), "terms")
    filled = kept.join(dealt, ["lang", "source"]).select(*keys, block.alias("block"), "term", "n", F.lit(0).cast("long").alias("terms"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    met = bare.unionByName(filled).select("lang", "block", "source", "chunk", "below", "term", "n", "terms", other).withColumn("x", F.least("chunk", "other")).withColumn("y", F.greatest("chunk", "other"))
    parts = met.drop("other").groupBy("lang", "block", "x", "y").applyInPandas(_compare, "lang string, source string, item string, value long")
    values = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # Sources of a language without kept terms are 0 apart.
    alone = groups.filter("kept = 0").select("lang", "source")
    zero = alone.join(alone.withColumnRenamed("source", "item"), "lang").filter("source != item").withColumn("value", F.lit(0).cast("long"))
    pairs = values.unionByName(zero).withColumn("part", F.lit("pair"))
    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    more = kept.filter("n > 0").join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (p - q).alias("value"), F.lit("term").alias("part")).filter("value > 0")
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    ranked = pairs.withColumn("rank", place).unionByName(more.withColumn("rank", place).filter(F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")
