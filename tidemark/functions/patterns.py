"""Many patterns at once: a trie with failure links over all of them, built once, sent to the tasks as bytes, and walked once for each text.

The time for a text depends on its length and on what is found in it, not on the number of patterns. Tables of patterns come in blocks of ``MAX_PATTERNS``, so an
automaton is bounded; a block is one more walk.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Sequence

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Patterns of one automaton.
MAX_PATTERNS = 200_000
#: Automata that a Python worker keeps between batches.
_KEPT: dict[str, ahocorasick.Automaton] = {}


class Patterns:
    """Substrings to look for, by their place in ``patterns``; an empty one is in every text."""

    def __init__(self, spark: SparkSession, patterns: Sequence[str]) -> None:
        if len(patterns) > MAX_PATTERNS:
            raise ValueError(f"more than {MAX_PATTERNS} patterns: use blocks")
        places: dict[str, list[int]] = {}
        for i, p in enumerate(patterns):
            places.setdefault(p, []).append(i)
        self.always = tuple(places.pop("", []))
        self.some = bool(places)
        trie = ahocorasick.Automaton()
        for p, at in places.items():
            trie.add_word(p, tuple(at))
        if places:
            trie.make_automaton()
        self.name = uuid.uuid4().hex
        self.sent: Broadcast[bytes] = spark.sparkContext.broadcast(pickle.dumps(trie))

    def __getstate__(self) -> dict[str, object]:
        return self.__dict__

    def found(self, text: str | None) -> set[int]:
        """Places of the patterns that ``text`` holds."""
        out = set(self.always)
        if text and self.some:
            trie = _KEPT.get(self.name)
            if trie is None:
                while len(_KEPT) >= 4:
                    _KEPT.pop(next(iter(_KEPT)))
                trie = _KEPT[self.name] = pickle.loads(self.sent.value)
            seen: set[tuple[int, ...]] = {at for _, at in trie.iter(text)}
            for at in seen:
                out.update(at)
        return out


def evaluate(patterns: Sequence[Patterns], texts: Sequence[Column], rule: Callable[..., object], kind: str) -> Column:
    """``rule`` of the patterns found in each of ``texts`` (one of ``patterns`` for each), a value of SQL type ``kind``; null texts are empty."""

    def run(columns: list[pd.Series]) -> pd.Series:
        return pd.Series([rule(*(p.found(x) for p, x in zip(patterns, row, strict=True))) for row in zip(*columns, strict=True)], dtype=object)

    if len(texts) == 1:

        @F.pandas_udf(kind)
        def one(a: pd.Series) -> pd.Series:
            return run([a])

        return one(*texts)

    @F.pandas_udf(kind)
    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return run([a, b])

    return two(*texts)


def contains_any(spark: SparkSession, text: Column, patterns: Sequence[str]) -> Column:
    """Whether ``text`` holds one of ``patterns``."""
    return evaluate([Patterns(spark, patterns)], [text], bool, "boolean")
