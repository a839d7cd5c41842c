"""Quality rules as a bitmask ledger: every rule is evaluated once, policies are applied afterwards.

``measure`` makes one pass over the texts and keeps measurements; ``ledger`` turns them into one failure bit a rule;
``apply_policy`` reads a versioned policy (a set of rules) against the bits; ``ablations`` counts, by bitwise
aggregation, what each rule rejects, rejects alone, and what would be kept without it.

Defined cases: null text has no words and no lines with a word; empty and null texts fail the base rule of least words; every row is judged by itself, so repeated rows
and null ids keep their rows; an empty table gives no rows; other columns are carried or ignored, never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = tk.byte_set((0x41, 0x5A))
#: ASCII letters, and the first byte of each character outside ASCII.
_LETTER = tk.byte_set((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xFF))

MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_upper long, n_letters long"


def _repeat_words(h: np.ndarray, words: tk.Words, k: int) -> np.ndarray:
    """Per document: words inside a ``k``-word window that occurs at least twice in it."""
    win, at = tk.windows(h, words, k)
    cover = np.zeros(len(h) + 1, np.int64)
    if len(win):
        key = tk.mix(win ^ (words.doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        order = np.argsort(key)
        s = key[order]
        same = np.zeros(len(s), bool)
        eq = s[1:] == s[:-1]
        same[1:] |= eq
        same[:-1] |= eq
        hit = at[order[same]]
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + k, -1)
    return tk.per_doc((np.cumsum(cover)[:-1] > 0).astype(np.int64), words.first)


def _dup_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document: lines with a word, and those equal to an earlier line."""
    n, dup = [], []
    raw = data.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        lines = [x for x in raw[a:b].split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
        n.append(len(lines))
        dup.append(len(lines) - len(set(lines)))
    return np.array(n, np.int64), np.array(dup, np.int64)


def _measure(column: pa.Array) -> list[np.ndarray]:
    data, off = tk.buffers(column)
    words = tk.find_words(data, off, tk.NONSPACE)
    h = tk.hash_spans(data, words.start, words.end)
    n_words = np.diff(words.first)
    lead = (data & 0xC0) != 0x80
    chars = np.r_[0, np.cumsum(lead)]
    word_chars = tk.per_doc(chars[words.end] - chars[words.start], words.first)
    count = lambda kind: (c := np.r_[0, np.cumsum(kind[data])])[off[1:]] - c[off[:-1]]
    n_lines, n_dup = _dup_lines(data, off)
    return [n_words, word_chars, count(_SYMBOL), n_lines, n_dup, _repeat_words(h, words, 5), count(_UPPER), count(_LETTER)]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id and the measurements of ``MEASURES``."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, *(x.split()[0] for x in MEASURES.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk.trim()
        for batch in batches:
            for a, b in tk.pieces(batch[1]):
                cols = _measure(batch[1].slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch[0].slice(a, b - a), *[pa.array(c.astype(np.int64)) for c in cols]], names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, {MEASURES}")


#: Rule name to failure condition. A rule's bit is its place here; new rules go to the end.
RULES = {
    "few_words": "n_words < 10",
    "repeat_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 20 * n_words",
    "dup_lines": "n_dup_lines >= 2 AND 100 * n_dup_lines > 30 * n_lines",
    "long_words": "word_chars > 14 * n_words",
    "short_words": "10 * word_chars < 22 * n_words",
    "upper_case": "100 * n_upper > 50 * n_letters",
}


@dataclass(frozen=True)
class Policy:
    """A named, versioned set of rules that reject."""

    version: str
    rejects: tuple[str, ...]

    def mask(self) -> int:
        names = list(RULES)
        return sum(1 << names.index(x) for x in self.rejects)


BASE = Policy("base-1", ("few_words", "repeat_words"))
STRICT = Policy("full-1", tuple(RULES))


def ledger(measured: DataFrame) -> DataFrame:
    """Adds ``fail_bits``: bit i is set if rule i fails."""
    bits = F.lit(0).cast("long")
    for i, test in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(test), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("fail_bits", bits)


def rejected(policy: Policy, bits: Column | None = None) -> Column:
    return (F.col("fail_bits") if bits is None else bits).bitwiseAND(F.lit(policy.mask()).cast("long")) != 0


def apply_policy(ledgered: DataFrame, policy: Policy) -> DataFrame:
    return ledgered.withColumn("kept", ~rejected(policy)).withColumn("policy", F.lit(policy.version))


def ablations(ledgered: DataFrame, policy: Policy) -> DataFrame:
    """``(rule, n_fail, n_alone, n_kept_without)`` per rule of the policy; ``n_kept_without`` counts what stays if it is off.

    One aggregation by failure bits (at most 2^rules rows), so the ledger is read once for all ablations.
    """
    groups = ledgered.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask()).cast("long")).alias("b")).agg(F.count("*").alias("n"))
    names = list(RULES)
    rows = F.explode(F.array(*[F.struct(F.lit(x).alias("rule"), F.lit(1 << names.index(x)).cast("long").alias("bit")) for x in policy.rejects]))
    each = groups.withColumn("r", rows)
    has = F.col("b").bitwiseAND(F.col("r.bit")) != 0
    rest = F.col("b").bitwiseAND(F.bitwise_not(F.col("r.bit")))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.coalesce(F.sum(F.when(has, F.col("n"))), F.lit(0)).alias("n_fail"),
        F.coalesce(F.sum(F.when(has & (rest == 0), F.col("n"))), F.lit(0)).alias("n_alone"),
        F.coalesce(F.sum(F.when(rest == 0, F.col("n"))), F.lit(0)).alias("n_kept_without"),
    )


def judge(docs: DataFrame) -> DataFrame:
    """Measurements, bits and the verdict of the full policy; ``base_failed`` is the base policy's."""
    done = apply_policy(ledger(measure(docs)), STRICT)
    return done.withColumn("base_failed", rejected(BASE))
