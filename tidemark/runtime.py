"""Session plumbing: importable workers, tables, the shared folder, written intermediates."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = str(Path(__file__).resolve().parent.parent)
#: Spark takes an input that it knows nothing of for larger than this.
UNKNOWN = 1 << 60


#: Arrow batches are bounded by bytes, so that long texts do not make long batches; settings made by the user stay.
_ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": (None, str(16 << 20))}


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it (an installed copy also serves), and bound Arrow batches."""
    for key, (default, ours) in _ARROW.items():
        now = spark.conf.get(key, None)
        if now in (default, None) or (default is None and int("".join(c for c in now if c.isdigit()) or 0) >= 1 << 26):
            spark.conf.set(key, ours)
    env = spark.sparkContext.environment
    paths = [x for x in env.get("PYTHONPATH", "").split(":") if x]
    if _ROOT not in paths:
        env["PYTHONPATH"] = ":".join([*paths, _ROOT])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which the driver and all executors share.

    A local session without that setting (unit tests) gets a folder of its own under /tmp/checkpoints; on a cluster that is an error, as
    executors do not see each other's local folders.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file:///tmp/checkpoints/tidemark-{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


def new_path(spark: SparkSession, tag: str, keep: bool = False) -> str:
    """A fresh path in the shared folder; inside :func:`scratch` one that goes with it, unless ``keep``."""
    base = None if keep else _SCRATCH.get()
    return f"{base or shared_dir(spark) + '/tidemark'}/{tag}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Intermediates written inside go at the end. What is read later has to be written with ``keep`` before."""
    path = new_path(spark, "scratch", keep=True)
    before = _SCRATCH.set(path)
    try:
        yield path
    finally:
        _SCRATCH.reset(before)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def partitions_for(df: DataFrame, mb: int = 128) -> int:
    """Partitions for an explicit shuffle of ``df``: as many as the session asks for, more if what it reads is larger than ``mb`` a partition.

    Sizes are those of the files that the plan scans; an input of unknown size (an RDD) counts nothing.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    size = sum(x for x in sizes if x < UNKNOWN)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // (mb << 20)))


def materialize(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, tag, keep)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only after counting: at most ``max_rows`` rows. Beyond that Spark shuffles both sides."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def broadcast_within(df: DataFrame, max_mb: int) -> DataFrame:
    """Hint a broadcast only after adding up bytes: those of strings, and 16 for every value. Beyond ``max_mb`` Spark shuffles both sides."""
    strings = [f"coalesce(octet_length(`{n}`), 0)" for n, kind in df.dtypes if kind in ("string", "binary")]
    size = df.selectExpr("sum(" + " + ".join([str(16 * len(df.columns)), *strings]) + ") AS n").first()["n"] or 0
    return F.broadcast(df) if size <= max_mb << 20 else df


def in_blocks(df: DataFrame, column: str, max_rows: int) -> list[DataFrame]:
    """``df`` in parts of about ``max_rows`` rows at most, dealt by the hash of ``column``: for joins that no key can shuffle."""
    n = -(-df.count() // max_rows)
    if n <= 1:
        return [df]
    parts = 2 * n  # room for uneven hashes
    return [df.filter(F.pmod(F.xxhash64(column), F.lit(parts)) == i) for i in range(parts)]
