"""Quality classifier: ordinal cumulative-link (proportional odds) regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds turn its score into grade probabilities,
P(grade <= k) = sigmoid(threshold_k - score). Documents are selected by the tail probability P(grade >= top).

Training takes at most ``MAX_TRAIN`` labelled documents, those with the smallest hashes of their ids (a documented bound; all documents are
scored). Features: words, their first 4 and 5 bytes, the last 3 bytes of tokens, and coarse shape counts, hashed to
``1 << BITS`` buckets. Buckets that speak against a grade boundary more than the largest of so many random ones would are fitted; all others weigh
nothing. (With buckets that speak for a boundary too, held-out good documents are lost: 2 % instead of none on the check tables.) A text is kept if
its tail probability reaches ``MIN_TAIL``, or comes within ``MARGIN`` of that of a text without evidence: where ratings are few or mostly bad, that
alone would reject everything.

Defined cases: null and empty texts have no words, only shape features, and are scored like any text; several labels of one
document count as its worst; labels with a null are ignored; without labels, or with one grade only, nothing is rejected; repeated rows and null ids keep
their rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .rule_ledger import _measure

BITS = 20
MAX_TRAIN = 5_000
MIN_DOCS = 5
STEPS = 200
RATE = 0.1
L2 = 3e-4
MIN_TAIL = 0.85
#: Log odds that have to speak against a text before it can be rejected.
MARGIN = 0.5
_U = np.uint64


@dataclass(frozen=True)
class OrdinalModel:
    """``weights`` by bucket and ascending ``thresholds``, one fewer than grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def least_tail(self, min_tail: float, margin: float = MARGIN) -> float:
        """The tail probability from which a text is kept."""
        return min(min_tail, float(1 / (1 + math.exp(min(self.thresholds[-1] + margin, 700)))))

    def grades(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. top, one column each."""
        return 1 / (1 + np.exp(self.thresholds[None, :] - score[:, None]))


def _buckets(h: np.ndarray, family: int) -> np.ndarray:
    return (tk.mix(h ^ _U(0x9E3779B97F4A7C15 * (family + 1) & (1 << 64) - 1)) >> _U(64 - BITS)).astype(np.int32)


def text_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Document and bucket of every feature occurrence of a batch."""
    data, off = tk.buffers(column)
    low = tk.LOWER[data]
    w = tk.find_words(data, off, tk.ALNUM)
    v = tk.find_words(data, off, tk.NONSPACE)
    ends = [w.end, np.minimum(w.start + 5, w.end), np.minimum(w.start + 4, w.end)]
    parts = [_buckets(tk.hash_spans(low, w.start, e), i) for i, e in enumerate(ends)]
    parts.append(_buckets(tk.hash_spans(data, np.maximum(v.end - 3, v.start), v.end), 3))
    m = _measure(column)
    words, letters, lines = np.maximum(m[0], 1), np.maximum(m[7], 1), np.maximum(m[3], 1)
    shape = np.stack([m[5] * 10 // words, 20 + m[4] * 10 // lines, 40 + m[6] * 10 // letters, 60 + np.minimum(m[2] * 10 // words, 10)], 1)
    parts.append(_buckets(shape.ravel().astype(_U), 4))
    docs = np.concatenate([w.doc, w.doc, w.doc, v.doc, np.repeat(np.arange(len(off) - 1), shape.shape[1])])
    return docs, np.concatenate(parts)


def _grouped(docs: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, bucket) pairs and their values: the root of the count, up to 3."""
    key, count = np.unique(docs.astype(np.int64) << BITS | buckets, return_counts=True)
    return key >> BITS, key & ((1 << BITS) - 1), np.sqrt(np.minimum(count, 3))


def training_rows(docs: DataFrame, ratings: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """``(grade, buckets, values)`` of at most ``max_train`` rated documents; ``ratings`` is ``(doc_id, grade)``."""
    worst = ratings.filter("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    sample = worst.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.trim()
        for batch in batches:
            for a, b in tk.pieces(batch[1]):
                row, bucket, value = _grouped(*text_features(batch[1].slice(a, b - a)))
                cut = np.searchsorted(row, np.arange(1, b - a))
                x = [v.astype("<i4").tobytes() for v in np.split(bucket, cut)]
                y = [v.astype("<f4").tobytes() for v in np.split(value, cut)]
                yield pa.RecordBatch.from_arrays([batch[0].slice(a, b - a), pa.array(x, pa.binary()), pa.array(y, pa.binary())], ["grade", "buckets", "vals"])

    rated = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    return rated.select("grade", "text").mapInArrow(run, "grade int, buckets binary, vals binary")


def fit_ordinal(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, grade: np.ndarray, n_grades: int) -> OrdinalModel:
    """Maximum likelihood with a ridge, by Adam over all rows; grades are weighted by the root of their rarity."""
    n, size = len(grade), 1 << BITS
    if n == 0 or len(np.unique(grade)) < 2:
        return OrdinalModel(np.zeros(size, np.float32), np.full(n_grades - 1, -9.0))
    docs_with = np.bincount(bucket, minlength=size).astype(float)
    chosen = np.zeros(size, bool)
    for cut in range(1, n_grades):
        high = (grade >= cut).astype(float)
        mean = min(max(high.mean(), 1e-6), 1 - 1e-6)
        got = np.bincount(bucket, weights=high[row], minlength=size)
        z = (got - docs_with * mean) / np.sqrt(np.maximum(docs_with * (1 - docs_with / n) * mean * (1 - mean), 1e-9))
        tested = docs_with >= MIN_DOCS
        chosen |= tested & (z <= -math.sqrt(2 * math.log(max(tested.sum(), 2))))
    keep = chosen[bucket]
    row, value = row[keep], value[keep]
    cols, col = np.unique(bucket[keep], return_inverse=True)
    share = np.bincount(grade, minlength=n_grades)
    rare = np.sqrt(n / np.maximum(share, 1))[grade]
    weight = rare / rare.mean()
    below = (np.cumsum(share)[:-1] + 0.5) / (n + 1)
    theta = np.log(below / (1 - below))
    theta += np.arange(len(theta)) * 1e-3
    w = np.zeros(len(cols))
    m, v = np.zeros(len(cols) + len(theta)), np.zeros(len(cols) + len(theta))
    at = np.arange(n)
    for t in range(1, STEPS + 1):
        s = np.bincount(row, value * w[col], minlength=n)
        inner = 1 / (1 + np.exp(s[:, None] - theta[None, :]))
        c = np.concatenate([np.zeros((n, 1)), inner, np.ones((n, 1))], 1)
        d = c * (1 - c)
        p = np.maximum(c[at, grade + 1] - c[at, grade], 1e-9)
        by_score = weight * (d[at, grade + 1] - d[at, grade]) / p
        by_theta = np.array([-(weight * ((grade == k) * d[:, k + 1] - (grade == k + 1) * d[:, k + 1]) / p).sum() / n for k in range(len(theta))])
        g = np.r_[np.bincount(col, value * by_score[row], minlength=len(cols)) / n + L2 * w, by_theta]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w -= step[: len(cols)]
        theta = np.maximum.accumulate(theta - step[len(cols) :] + np.arange(len(theta)) * 1e-9)
    weights = np.zeros(size, np.float32)
    weights[cols] = w
    return OrdinalModel(weights, theta)


def fit(docs: DataFrame, ratings: DataFrame, n_grades: int = 3, max_train: int = MAX_TRAIN) -> OrdinalModel:
    """Fit on the bounded sample, which is all that reaches the driver."""
    rows = training_rows(docs, ratings, max_train).collect()
    rows.sort(key=lambda r: (r["grade"], bytes(r["buckets"])))  # sums come out alike whatever the order of tasks
    grade = np.array([min(max(r["grade"], 0), n_grades - 1) for r in rows], np.int64)
    xs = [np.frombuffer(r["buckets"], "<i4") for r in rows]
    ys = [np.frombuffer(r["vals"], "<f4") for r in rows]
    none = [np.zeros(0)]
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(x) for x in xs]) if rows else np.zeros(0, np.int32)
    del rows
    return fit_ordinal(row, np.concatenate(xs or none).astype(np.int32), np.concatenate(ys or none).astype(np.float32), grade, n_grades)


def grade_ratings(labels: DataFrame) -> DataFrame:
    """Labels (quality 0/1, toxic 0/1) as grades: 0 poor, 1 written well but toxic, 2 good."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2).alias("grade"))


def tails(model: OrdinalModel, column: pa.Array) -> np.ndarray:
    """P(grade >= k) of each text of a batch, one column for each k from 1."""
    doc, bucket = text_features(column)
    has = model.weights[bucket] != 0
    row, bucket, value = _grouped(doc[has], bucket[has])
    return model.grades(np.bincount(row, value * model.weights[bucket], minlength=len(column)))


def score(docs: DataFrame, model: OrdinalModel, min_tail: float = MIN_TAIL) -> DataFrame:
    """``(doc_id, row, expected_grade, tail_prob, kept)`` per row of ``docs``; ``row`` is the hash of its text."""
    shared, least = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds)), model.least_tail(min_tail)  # 4 MB, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.trim()
        for batch in batches:
            for a, b in tk.pieces(batch[2]):
                tail = tails(OrdinalModel(*shared.value), batch[2].slice(a, b - a))
                cols = [tail.sum(1), tail[:, -1], tail[:, -1] >= least]
                yield pa.RecordBatch.from_arrays([batch[0].slice(a, b - a), batch[1].slice(a, b - a), *map(pa.array, cols)], ["doc_id", "row", "expected_grade", "tail_prob", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("row"), "text").mapInArrow(run, f"doc_id {kind}, row long, expected_grade double, tail_prob double, kept boolean")


def keep_good(docs: DataFrame, model: OrdinalModel, min_tail: float = MIN_TAIL) -> DataFrame:
    """``docs`` without the rows that the model rejects, all columns kept. The verdict is a filter on the text itself."""
    shared, least = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds)), model.least_tail(min_tail)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.trim()
        for batch in batches:
            column = batch.column(at)
            for a, b in tk.pieces(column):
                tail = tails(OrdinalModel(*shared.value), column.slice(a, b - a))
                yield batch.slice(a, b - a).filter(pa.array(tail[:, -1] >= least))

    at = docs.columns.index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names with dots or quotes are no names for a worker's input
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
