"""Feeds, result lists, pages, the article history and drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import parse_pubdate
from ..functions.text import feed_title, normalize_snippet, normalize_title, strip
from ..operators.hits import dedupe_hits, host_blocklist, require

ITEM = T.StructType([T.StructField(x, T.StringType()) for x in ("title", "link", "description", "pubDate")])
RESULT = T.StructType([T.StructField(x, T.StringType()) for x in ("title", "href", "body")])
_TIME = ("source_published_at", "created_at", "published_at")
ARTICLES = T.StructType(
    [T.StructField(x, T.TimestampType() if x in _TIME else T.StringType()) for x in ("id", "title", "source_url", "source_published_at", "extracted_text", "summary", "status", "created_at", "published_at")]
    + [T.StructField("batch_id", T.LongType())]
)


def read_feed(spark: SparkSession, path: str, max_results: int, unclosed: bool = True) -> DataFrame:
    """``item`` elements of XML feeds, wherever they stand (inside a channel or beside it), as hits ``(file, pos, title, url, snippet, published_at)``, at
    most ``max_results`` a file. An item is a row from the start; ``pos`` is its place in its file. ``unclosed`` as in :func:`unescape_html`.
    """
    items = spark.read.format("xml").option("rowTag", "item").schema(ITEM).load(path)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    items = items.select(F.col("_metadata.file_path").alias("file"), place.alias("__at"), *ITEM.names)
    items = items.withColumn("pos", F.row_number().over(Window.partitionBy("file").orderBy("__at")) - 1)
    full = require(items, ["title", "link"])
    hits = full.select("file", "pos", feed_title("title", "description", unclosed=unclosed).alias("title"), strip("link").alias("url"), normalize_snippet("description", unclosed).alias("snippet"), parse_pubdate("pubDate").alias("published_at"))
    first = hits.withColumn("__rn", F.row_number().over(Window.partitionBy("file").orderBy("pos"))).filter(F.col("__rn") <= max_results).drop("__rn")
    return dedupe_hits(first, ["file"], ["pos"], max_results)


def read_results(df: DataFrame, as_of: Column, unclosed: bool = True) -> DataFrame:
    """Search results ``(title, href, body, ...)`` as hits stamped ``as_of``; rows without title or URL, and blocked hosts, go."""
    other = [c for c in df.columns if c not in ("title", "href", "body")]
    hits = df.select(*other, normalize_title("title").alias("title"), strip(F.coalesce("href", F.lit(""))).alias("url"), normalize_snippet("body", unclosed).alias("snippet"), as_of.alias("published_at"))
    return host_blocklist(require(hits, ["title", "url"]))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, url, html)`` from Parquet."""
    return spark.read.schema("page_id long, url string, html string").parquet(path)


def read_raw_pages(spark: SparkSession, path: str) -> DataFrame:
    """``(path, body)`` of files of raw page bytes."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("body"))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The article history; missing columns are null. A damaged store is an error: taking it for empty would lose it on the next write."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], ARTICLES)
    return spark.read.schema(ARTICLES).parquet(path)


def import_history(spark: SparkSession, path: str) -> DataFrame:
    """History from a JSON array file; absent fields are null."""
    return spark.read.schema(ARTICLES).json(path, multiLine=True)


def append_history(df: DataFrame, path: str) -> None:
    """Add records as one partition per batch; a batch written again replaces its own partition only."""
    df.select(*ARTICLES.names).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def write_drafts(df: DataFrame, path: str, draft: str = "draft") -> None:
    df.select(F.to_json(draft).alias("value")).write.mode("overwrite").text(path)
