"""Shared plumbing of the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, in_blocks, materialize, new_path, partitions_for, prepare, scratch, shared_dir, table

__all__ = ["all_columns", "broadcast_if_small", "free_names", "in_blocks", "materialize", "new_path", "null_safe", "partitions_for", "prepare", "scratch", "shared_dir", "table", "text_key"]


def text_key(text: Column | str) -> Column:
    """64-bit hash of a text; with doc_id it tells rows of one repeated id apart (equal rows share all results)."""
    return F.xxhash64(text)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores after it as keep it apart from the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def all_columns(df: DataFrame) -> list[Column]:
    """The columns of ``df`` for a select, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def null_safe(left: DataFrame, right: DataFrame, cols: list[str], how: str) -> DataFrame:
    """Join on equal ``cols`` where null equals null; the right side's key columns are dropped."""
    marked = right.select(*[F.col(c).alias(f"__r_{c}") if c in cols else F.col(c) for c in right.columns])
    on = None
    for c in cols:
        test = left[c].eqNullSafe(marked[f"__r_{c}"])
        on = test if on is None else on & test
    return left.join(marked, on, how).drop(*[f"__r_{c}" for c in cols])
