"""Date texts to timestamps; what cannot be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, strip


def parse_pubdate(c: Column | str) -> Column:
    """RFC 2822 date with an offset or zone name."""
    x = F.regexp_replace(strip(col(c)), r"^[A-Za-z]{3,9},\s*", "")
    forms = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm z"]
    return F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in forms])


def parse_iso(c: Column | str) -> Column:
    """ISO 8601 text with an offset or ``Z``; text without one is null."""
    x = strip(col(c))
    zoned = x.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?([+-]\d{2}:\d{2}|Z)$")
    return F.when(zoned, F.try_to_timestamp(x))
