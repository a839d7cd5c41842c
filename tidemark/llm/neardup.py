"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

1. Document frequencies of all five-word shingles are counted over all documents in a count sketch of fixed size (two rows of
   ``WIDTH`` counters, 8 MB whatever the corpus). A shingle weighs its count times a mild inverse document frequency,
   ``1 + IDF_SHARE * log(N / df) / log(N)``: mild, so that shingles of a large group of copies keep their say.
2. Each text gets ``BANDS * ROWS`` weighted samples; texts that agree on all rows of a band share a bucket.
3. Buckets are range-partitioned with a secondary sort, and each text is paired with its neighbour there: a chain, so a
   bucket of n texts gives n - 1 candidates, never all pairs. Different bands order and mix a group differently.
4. Candidates are verified by the weighted Jaccard similarity of whole texts. The first ``FIRST`` bands go first; pairs of the others
   are verified only where the two texts are not yet connected. Links give classes by connected components.
5. Then every bucket's members that are not connected to its hub (its text with most links, as a rule the original of a group) are paired with
   the hub and verified, until a round finds no new link.
6. Members of buckets that still hold unconnected texts (many texts with a long passage in common, say) go through an exact weighted
   prefix join: each such pair is verified, or a bound on its common weight shows that it is not similar.

Equal texts are one node from the start, so copies cost nothing after the signatures.

Defined cases: null and empty texts are equal texts like any other; texts of fewer than five words have one shingle of all
their words, texts without words none (they match equal texts only); rows that repeat a doc_id are kept as rows, and a null doc_id
is larger than any other when the representative (the smallest doc_id of a class) is chosen; an empty table gives no rows; other
columns are carried by :func:`keep_one` whatever their names. Texts are told apart by a 64-bit hash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import all_columns, broadcast_if_small, free_names, materialize, partitions_for, text_key
from .components import absorb, components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS, FIRST = 12, 3, 4
WIDTH = 1 << 20
CHUNKS = 256
IDF_SHARE = 0.1
#: (node, id) rows of 16 bytes that are broadcast to pick texts for verification; more are joined by a shuffle.
MAX_PICKED = 1_000_000
_U = np.uint64

#: -log of a uniform number given as 16 bits, for the Gamma(2, 1) variables.
_NEGLOG = (-np.log((np.arange(1 << 16) + 0.5) / (1 << 16))).astype(np.float32)


def _shingles(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every shingle of a batch; words are A-Z lower-cased alphanumeric runs."""
    data, off = tk.buffers(column)
    words = tk.find_words(data, off, tk.ALNUM)
    return tk.shingles(tk.hash_spans(tk.LOWER[data], words.start, words.end), words, k)


def _counted(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) pairs in document order, and their counts."""
    if not len(h):
        return h, doc, np.zeros(0, np.int64)
    order = np.argsort(h)
    order = order[np.argsort(doc[order], kind="stable")]
    h, doc = h[order], doc[order]
    start = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
    return h[start], doc[start], np.diff(np.r_[start, len(h)])


def _cells(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bits = _U(64 - WIDTH.bit_length() + 1)
    return (h >> bits).astype(np.int64), (tk.mix(h ^ _U(0x5851F42D4C957F2D)) >> bits).astype(np.int64)


def shingle_sketch(docs: DataFrame, k: int = SHINGLE) -> np.ndarray:
    """Document counts of all shingles in a 2 x ``WIDTH`` sketch.

    Every task adds up its own sketch and sends it in ``CHUNKS`` compressed pieces; a piece's copies are added where they meet.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.trim()
        total = np.zeros((2, WIDTH), np.uint32)
        for batch in batches:
            for a, b in tk.pieces(batch[0]):
                h, _, _ = _counted(*_shingles(batch[0].slice(a, b - a), k))
                for row, cell in zip(total, _cells(h), strict=True):
                    row += np.bincount(cell, minlength=WIDTH).astype(np.uint32)
        parts = total.reshape(CHUNKS, -1)
        used = np.flatnonzero(parts.any(1))
        for i in range(0, len(used), 64):
            ids = used[i : i + 64]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array([zlib.compress(parts[j].tobytes(), 1) for j in ids], pa.binary())], ["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, raw in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(raw), np.uint32)
                sums[c] = sums[c] + part if c in sums else part.astype(np.uint64)
        for c, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([zlib.compress(v.astype(np.uint64).tobytes(), 1)], pa.binary())], ["chunk", "counts"])

    schema = "chunk int, counts binary"
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = np.zeros((CHUNKS, 2 * WIDTH // CHUNKS), np.uint64)
    for r in docs.select("text").mapInArrow(count, schema).repartition(n, "chunk").mapInArrow(add, schema).collect():
        out[r["chunk"]] = np.frombuffer(zlib.decompress(r["counts"]), np.uint64)
    return out.reshape(2, WIDTH)


def idf_table(sketch: np.ndarray, n_docs: int, share: float = IDF_SHARE) -> np.ndarray:
    """Inverse document frequency weight of each sketch cell, less the mean load that other shingles put on it."""
    n = max(n_docs, 2)
    df = np.maximum(sketch.astype(np.float64) - np.floor(sketch.mean(1, keepdims=True)), 1.0)
    return (1 + share * np.log(np.maximum(n / df, 1.0)) / np.log(n)).astype(np.float32)


def _weights(h: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    a, b = _cells(h)
    return count.astype(np.float32) * np.maximum(idf[0][a], idf[1][b])


def weighted_samples(h: np.ndarray, w: np.ndarray, first: np.ndarray, n_hashes: int) -> np.ndarray:
    """Improved consistent weighted samples: one 64-bit value per document (slice of ``first``) and hash.

    For shingle x of weight w: r, c ~ Gamma(2, 1) and b ~ U(0, 1) from hashes of x; t = floor(log w / r + b) and
    log a = log c - r (t - b) - r. The sample is the (x, t) of the smallest a; its value holds a's bits and a hash of (x, t).
    """
    n = len(first) - 1
    out = np.full((n, n_hashes), np.iinfo(np.uint64).max, _U)
    some = np.flatnonzero(np.diff(first) > 0)
    if not len(some):
        return out
    at = first[some]
    logw = np.log(w)
    for k in range(n_hashes):
        best = np.empty(len(h), _U)
        for i in range(0, len(h), 1 << 16):
            x = h[i : i + (1 << 16)]
            z = tk.mix(x ^ _U((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            q = z.view(np.uint16).reshape(-1, 4)
            r = _NEGLOG[q[:, 0]] + _NEGLOG[q[:, 1]]
            c = _NEGLOG[q[:, 2]] + _NEGLOG[q[:, 3]]
            z2 = z * _U(0xD1342543DE82EF95)
            b = (z2 >> _U(40)).astype(np.float32) * np.float32(2.0**-24)
            t = np.floor(logw[i : i + (1 << 16)] / r + b)
            a = np.log(c) - r * (t - b + np.float32(1))
            bits = a.view(np.int32)
            order = np.where(bits < 0, ~bits, bits | np.int32(-(1 << 31))).view(np.uint32).astype(_U)
            tag = (z2 + t.astype(np.int64).view(_U) * _U(0x2545F4914F6CDD1D)) >> _U(32)
            best[i : i + (1 << 16)] = (order << _U(32)) | tag
        out[some, k] = np.minimum.reduceat(best, at)
    return out


def signatures(docs: DataFrame, idf: np.ndarray, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(doc_id, node, weight, bands)`` per row of ``docs``; node is the text's hash, bands its bucket keys."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.trim()
        for batch in batches:
            for a, b in tk.pieces(batch[2]):
                h, doc, count = _counted(*_shingles(batch[2].slice(a, b - a), k))
                w = _weights(h, count, shared.value)
                first = np.searchsorted(doc, np.arange(b - a + 1))
                sig = weighted_samples(h, w, first, bands * rows)
                keys = np.zeros((b - a, bands), _U)
                for j in range(bands):
                    for i in range(rows):
                        keys[:, j] = tk.mix(keys[:, j] * _U(0x9E3779B97F4A7C15) + sig[:, j * rows + i] + _U(j))
                has = np.diff(first) > 0
                offsets = np.r_[0, np.cumsum(np.where(has, bands, 0))].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[has].ravel().view(np.int64)))
                total = np.bincount(doc, weights=w, minlength=b - a).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch[0].slice(a, b - a), batch[1].slice(a, b - a), pa.array(total), lists], ["doc_id", "node", "weight", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    src = docs.select("doc_id", text_key("text").alias("node"), "text")
    return src.mapInArrow(run, f"doc_id {kind}, node long, weight double, bands array<long>")


def chain_pairs(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs ``(a, b, band)`` of each text and its neighbour in each bucket, a < b; and members ``(key, node)`` of the buckets of more than one.

    In even bands a bucket is sorted by total weight (texts that differ much in weight cannot be similar), in odd ones by a hash, so that a
    text meets other neighbours in each. Sorted rows are streamed partition by partition; the row before a partition's first
    one is found among the partitions' last rows (two rows a partition).
    """
    each = signed.select("node", "weight", F.posexplode("bands").alias("band", "key"))
    each = each.groupBy("node", "band", "key").agg(F.min("weight").alias("weight"))
    each = each.withColumn("place", F.when(F.col("band") % 2 == 0, F.col("weight")).otherwise(F.xxhash64("node", "band").cast("double")))
    n = partitions_for(signed)
    order = ["key", "place", "node"]
    ordered = each.select("band", *order).repartitionByRange(n, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        names = ["kind", "part", "band", "key", "a", "b"]

        def rows(kind: int, band, key, a, b) -> pa.RecordBatch:
            m = len(a)
            return pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int32)), pa.array(np.full(m, part, np.int32)), pa.array(band), pa.array(key), pa.array(a), pa.array(b)], names)

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            band, key, node = (batch[i].to_numpy(zero_copy_only=False) for i in (0, 1, 3))
            if last is None:
                yield rows(1, band[:1], key[:1], node[:1], node[:1])
            else:
                band, key, node = (np.r_[x, y] for x, y in zip(last, (band, key, node), strict=True))
            hit = np.flatnonzero(key[1:] == key[:-1])
            if len(hit):
                yield rows(0, band[hit], key[hit], node[hit], node[hit + 1])
            last = band[-1:], key[-1:], node[-1:]
        if last is not None:
            yield rows(2, last[0], last[1], last[2], last[2])

    made = materialize(ordered.mapInArrow(run, "kind int, part int, band int, key long, a long, b long"), "chains")
    # A bucket that fills several partitions: join each partition's last row with the next one's first row.
    ends = sorted(made.filter("kind > 0").select("part", "kind", "band", "key", "a").collect(), key=lambda r: (r["part"], r["kind"]))
    over = [(x["band"], x["key"], x["a"], y["a"]) for x, y in zip(ends, ends[1:], strict=False) if x["kind"] == 2 and y["kind"] == 1 and x["key"] == y["key"]]
    steps = made.filter("kind = 0").select("band", "key", "a", "b").unionByName(signed.sparkSession.createDataFrame(over, "band int, key long, a long, b long")).filter("a != b")
    pairs = steps.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "band").groupBy("a", "b").agg(F.min("band").alias("band"))
    members = steps.select("key", F.col("a").alias("node")).unionByName(steps.select("key", F.col("b").alias("node"))).distinct()
    return materialize(pairs, "chain-pairs"), materialize(members, "members")


def _degrees(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose two nodes are in different components."""
    known = broadcast_if_small(roots, MAX_PICKED)
    out = pairs
    for end in ("a", "b"):
        out = out.join(known.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    return out.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def hub_pairs(members: DataFrame, roots: DataFrame, links: DataFrame) -> DataFrame:
    """Each bucket's members that are not connected to its hub, paired with it; the hub is the member with most links."""
    full = members.join(broadcast_if_small(roots, MAX_PICKED), "node", "left").join(broadcast_if_small(_degrees(links), MAX_PICKED), "node", "left")
    full = materialize(full.select("key", "node", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n")), "bucket-members")
    hubs = full.groupBy("key").agg(F.max(F.struct("n", "node", "root")).alias("hub"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi")
    hubs = materialize(hubs.select("key", F.col("hub.node").alias("hub"), F.col("hub.root").alias("hub_root")), "hubs")
    met = full.join(broadcast_if_small(hubs, MAX_PICKED), "key").filter("root != hub_root")
    return met.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def open_nodes(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``(node, root)`` of the members of all buckets whose members are not all connected."""
    full = materialize(members.join(broadcast_if_small(roots, MAX_PICKED), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "bucket-roots")
    mixed = full.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("key")
    mixed = materialize(mixed, "mixed-buckets")
    return materialize(full.join(broadcast_if_small(mixed, MAX_PICKED), "key").select("node", "root").distinct(), "open-nodes")


def prefix_pairs(docs: DataFrame, nodes: DataFrame, opened: DataFrame, idf: np.ndarray, similarity: float = SIMILARITY, k: int = SHINGLE) -> DataFrame:
    """Pairs ``(a, b)`` of ``opened`` in different components, without those whose similarity a bound keeps below ``similarity``.

    All shingles have one order, the rarest first. What two texts have in common weighs no more than what either has from their first
    common shingle on, and at ``similarity`` t it has to weigh t / (1 + t) of both texts together. So a text gives its shingles up to a rest of t
    of its weight, and the lighter of a pair has a common one up to a rest of 2t / (1 + t) (``lead``); a passage that all have in common
    comes after that unless it makes texts similar by itself. Texts of one component do not meet: a shingle's leads are
    joined with its other components first, then with their texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    low = 1 - 1e-6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.trim()
        for batch in batches:
            for i, j in tk.pieces(batch[2]):
                part = batch.slice(i, j - i)
                h, doc, count = _counted(*_shingles(part[2], k))
                a, b = _cells(h)
                rare = np.maximum(shared.value[0][a], shared.value[1][b])
                order = np.lexsort((h, -rare, doc))
                h, doc, w = h[order], doc[order], _weights(h, count, shared.value).astype(np.float64)[order]
                total = np.bincount(doc, weights=w, minlength=j - i)
                before = np.cumsum(w) - w
                first = np.searchsorted(doc, np.arange(j - i))
                rest = total[doc] - (before - before[first[doc]])
                ok = np.flatnonzero(rest >= similarity * total[doc] * low)
                at = pa.array(doc[ok])
                whole = total[doc[ok]]
                lead = rest[ok] >= 2 * similarity / (1 + similarity) * whole * low
                yield pa.RecordBatch.from_arrays([pa.array(h[ok].view(np.int64)), part[0].take(at), part[1].take(at), pa.array(whole), pa.array(rest[ok]), pa.array(lead)], ["token", "node", "root", "weight", "rest", "lead"])

    texts = picked_texts(docs, nodes, opened.select("node")).join(opened, "node").select("node", "root", "text")
    each = materialize(texts.mapInArrow(run, "token long, node long, root long, weight double, rest double, lead boolean"), "prefixes")
    mixed = each.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("lead").alias("led")).filter("led and lo != hi").select("token")
    each = materialize(each.join(mixed, "token"), "prefixes-met")
    need = similarity / (1 + similarity) * low
    groups = each.groupBy("token", "root").agg(F.max("rest").alias("most"), F.min("weight").alias("light"), F.max("weight").alias("heavy")).withColumnRenamed("root", "root_b")
    leads = each.filter("lead").select("token", F.col("node").alias("a"), F.col("root").alias("root_a"), F.col("weight").alias("wa"), F.col("rest").alias("ra"))
    meet = leads.join(groups, "token").filter(F.col("root_a") != F.col("root_b")).filter("heavy >= wa").filter(F.least("ra", "most") >= need * (F.col("wa") + F.greatest("wa", "light")))
    others = each.select("token", F.col("root").alias("root_b"), F.col("node").alias("b"), F.col("weight").alias("wb"), F.col("rest").alias("rb"))
    met = meet.select("token", "root_b", "a", "wa", "ra").join(others, ["token", "root_b"]).filter("wb >= wa").filter(F.least("ra", "rb") >= need * (F.col("wa") + F.col("wb")))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def weighted_jaccard(left: pa.Array, right: pa.Array, idf: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Weighted Jaccard similarity of two columns of texts, row by row; 0 if either has no words."""
    n = len(left)
    ha, da, ca = _counted(*_shingles(left, k))
    hb, db, cb = _counted(*_shingles(right, k))
    wa, wb = _weights(ha, ca, idf).astype(np.float64), _weights(hb, cb, idf).astype(np.float64)
    h, d, w = np.r_[ha, hb], np.r_[da, db], np.r_[wa, wb]
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(d[order], kind="stable")]
    h, d, w = h[order], d[order], w[order]
    same = np.flatnonzero((h[1:] == h[:-1]) & (d[1:] == d[:-1]))
    both = np.bincount(d[same], weights=np.minimum(w[same], w[same + 1]), minlength=n)
    total = np.bincount(d, weights=w, minlength=n)
    return np.divide(both, total - both, out=np.zeros(n), where=total > both)


def picked_texts(docs: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """``(node, text)`` of the nodes ``ids``, one row each."""
    picked = materialize(nodes.join(ids, "node"), "picked")
    texts = docs.select("doc_id", text_key("text").alias("node"), "text").join(broadcast_if_small(picked, MAX_PICKED), "node").filter(F.col("doc_id").eqNullSafe(F.col("rep")))
    return materialize(texts.groupBy("node").agg(F.max("text").alias("text")), "picked-texts")


def verify(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, idf: np.ndarray, similarity: float = SIMILARITY, k: int = SHINGLE) -> DataFrame:
    """``(a, b, sim)``: the pairs whose whole texts reach ``similarity``. ``nodes`` is ``(node, rep)``, one row a node."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    ids = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    texts = picked_texts(docs, nodes, ids)
    joined = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.trim()
        for batch in batches:
            for a, b in tk.pieces(batch[2]):
                part = batch.slice(a, b - a)
                sim = weighted_jaccard(part[2], part[3], shared.value, k)
                ok = np.flatnonzero(sim >= similarity)
                yield pa.RecordBatch.from_arrays([part[0].take(pa.array(ok)), part[1].take(pa.array(ok)), pa.array(sim[ok])], ["a", "b", "sim"])

    return joined.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, sim double")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE) -> DataFrame:
    """Per row of ``docs``: doc_id, node (its text's hash), root (the smallest node of its class, which identifies the class), class_id (the
    smallest doc_id of its class; classes may share one where a doc_id repeats or is null), n_links of its text."""
    src = docs.select("doc_id", "text")
    sketch = shingle_sketch(src, k)
    idf = idf_table(sketch, src.count())
    signed = materialize(signatures(src, idf, k), "signatures")
    nodes = materialize(signed.groupBy("node").agg(F.min("doc_id").alias("rep")), "nodes")
    chains, members = chain_pairs(signed)
    rounds: list[DataFrame] = []
    tested = chains.filter(F.col("band") < FIRST).select("a", "b")
    links = materialize(verify(src, nodes, tested, idf, similarity, k), "links-0")
    roots = components(links)
    fresh = materialize(_apart(chains.filter(F.col("band") >= FIRST), roots), "chain-rest")
    while True:
        more = materialize(verify(src, nodes, fresh, idf, similarity, k), "links-more")
        found = more.limit(1).count() > 0
        tested = tested.unionByName(fresh)
        links = links.unionByName(more)
        if found:
            roots = absorb(roots, more)
        elif len(rounds):
            break
        fresh = materialize(hub_pairs(members, roots, links).join(tested, ["a", "b"], "left_anti"), "hub-pairs")
        rounds.append(fresh)
    rest = materialize(prefix_pairs(src, nodes, open_nodes(members, roots), idf, similarity, k).join(tested, ["a", "b"], "left_anti"), "prefix-pairs")
    more = materialize(verify(src, nodes, rest, idf, similarity, k), "links-prefix")
    if more.limit(1).count():
        links = links.unionByName(more)
        roots = absorb(roots, more)
    degree = _degrees(links)
    member = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = member.groupBy("root").agg(F.min("rep").alias("class_id"))
    classes = materialize(member.join(least, "root").join(degree, "node", "left").select("node", "root", "class_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")), "classes")
    return signed.select("doc_id", "node").join(broadcast_if_small(classes, MAX_PICKED), "node").select("doc_id", "node", "root", "class_id", "n_links")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest doc_id (of rows equal in id and text, the one
    whose columns have the smallest hash, so that a retry gives the same)."""
    found = materialize(near_duplicates(docs.select("doc_id", "text"), similarity, k), "near-duplicates")
    doc, keep, n_rows, node, mark, least = free_names(docs, "doc", "keep", "n_rows", "node", "mark", "least")
    rows = found.groupBy("root", "doc_id", "node").agg(F.count("*").alias("rows"))
    stay = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node", "rows")).alias("r"))
    stay = materialize(stay.select(F.col("r.doc_id").alias(doc), F.col("r.node").alias(keep), F.col("r.rows").alias(n_rows)), "stay")
    kept = docs.withColumn(node, text_key("text")).join(broadcast_if_small(stay, MAX_PICKED), F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(node) == F.col(keep)))
    out = kept.filter(F.col(n_rows) == 1).select(*all_columns(docs))
    if stay.filter(F.col(n_rows) > 1).limit(1).count():
        hashed = [c for c, (_, kind) in zip(all_columns(docs), docs.dtypes, strict=True) if "map<" not in kind]
        same = kept.filter(F.col(n_rows) > 1).withColumn(mark, F.xxhash64(*hashed))
        first = same.groupBy(F.col(keep).alias("__keep"), F.col(doc).alias("__doc")).agg(F.min(mark).alias(least))
        one = same.join(first, (F.col(keep) == F.col("__keep")) & F.col(doc).eqNullSafe(F.col("__doc")) & (F.col(mark) == F.col(least)))
        out = out.unionByName(one.dropDuplicates([doc, keep]).select(*all_columns(docs)))
    return out
