"""The composed runs: candidates, articles, outcomes, drafts, history."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import block_text, decode_bytes, image_candidates, page_text, page_title, pick_cover
from ..functions.text import is_too_short
from ..functions.urls import canonical_url
from ..operators.drafts import article_record, settle_drafts
from ..operators.hits import BLOCKED_HOSTS, assert_covered, filter_by_age, from_first_source, require, resolve_alias, site_then_global, top_candidates, unique_candidates
from ..operators.resolve import classify, run_stats
from ..operators.rules import rule_filter
from ..operators.similar import Duplicates, exists_duplicate
from ..runtime import materialize
from ..sources.store import append_history


@dataclass(frozen=True)
class Params:
    as_of: Column
    max_hours: int = 14
    max_candidates: int | None = 20
    max_results: int | None = 20
    blocked: tuple[str, ...] = BLOCKED_HOSTS
    author: str = "16"
    default_cover: str = ""
    batch_id: int = 0


def collect_candidates(hits: DataFrame, queries: DataFrame | None, params: Params, alias: DataFrame | None = None) -> DataFrame:
    """Hits to the run's candidates: aliases resolved, each tool's list of sites and global hits without blocked hosts and repeats and capped, the first
    source with rows per query, every query covered, first hit per canonical URL, age, cap."""
    full = require(hits, ["title", "url"])
    known = full if alias is None else resolve_alias(full, alias)
    # Written once: the first source of a query and the check below look at all of it again.
    listed = materialize(site_then_global(known, params.max_results, params.blocked), "hits-of-calls")
    chosen = from_first_source(listed)
    if queries is not None:
        assert_covered(queries, chosen)
    fresh = filter_by_age(unique_candidates(chosen), "published_at", params.max_hours, params.as_of)
    return top_candidates(fresh, params.max_candidates)


def extract_articles(pages: DataFrame, hits: DataFrame, covers: bool = True, unclosed: bool = True) -> DataFrame:
    """Pages of the hits as ``(id, ord, url, title, text, published_at, cover_url, page_missing)``, joined by canonical URL.

    ``pages`` has html, or instead of it the bytes as they came: body, encoding, content_type. ``unclosed`` as in :func:`unescape_html`.
    """
    if "html" not in pages.columns:
        pages = pages.withColumn("html", decode_bytes("body", "encoding", "content_type"))
    keyed = hits.withColumn("id", canonical_url("url"))
    found = pages.select(canonical_url("url").alias("id"), "page_id", F.col("url").alias("page_url"), "html").join(keyed.select("id"), "id", "left_semi")
    one = materialize(found.groupBy("id").agg(F.min_by(F.struct("page_id", "page_url", "html"), "page_id").alias("p")), "pages-of-hits")
    joined = keyed.join(one, "id", "left")
    text = page_text(block_text("p.html", unclosed=unclosed), "snippet")
    out = joined.select("id", "query_ord", "scope_rank", "pos", "url", page_title("p.html", "title", unclosed=unclosed).alias("title"), text.alias("text"), "published_at", F.col("p.page_id").alias("page_id"), F.col("p").isNull().alias("page_missing"))
    if covers:
        shown = one.select("id", "p.page_id", F.col("p.page_url").alias("url"), "p.html")
        cover = pick_cover(image_candidates(shown))
        out = out.join(cover, "page_id", "left")
    else:
        out = out.withColumn("cover_url", F.lit(None).cast("string"))
    order = F.struct("query_ord", "scope_rank", "pos")
    return out.withColumn("ord", order).drop("query_ord", "scope_rank", "pos")


def outcomes(articles: DataFrame, history: DataFrame, rules: DataFrame, fails: Callable[[DataFrame], DataFrame] | None = None, lookup: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``(id, status)`` of articles against the history and each other. ``lookup`` compares rows with the history in place of :func:`exists_duplicate`.

    ``fails`` gives ``(id)`` of those published articles whose draft fails. These suppress nothing, so the others are resolved again without
    them, until no further draft fails; what the rows are compared by is computed once.
    """
    flags = rule_filter(articles, rules).withColumn("too_short", is_too_short("text"))
    present = articles.filter("NOT page_missing")
    asked = present.select("id", "url", "title", "text")
    dup = exists_duplicate(asked, history) if lookup is None else lookup(asked)
    rows = flags.join(dup.select("id", "is_dup"), "id", "left").select(
        "id", "ord", "page_missing", F.coalesce("is_dup", F.lit(False)).alias("in_history"), "too_short", F.col("flagged").alias("policy"), F.lit(False).alias("draft_failed")
    )
    rows = materialize(rows, "run-rows")
    same = Duplicates(present)
    while True:
        done = materialize(classify(rows, same.resolve), "run-status")
        if fails is None:
            return done
        published = articles.join(done.filter("status = 'published'").select("id"), "id", "left_semi")
        failed = materialize(fails(published).select("id").distinct(), "run-failed")
        if not failed.limit(1).count():
            return done
        rows = materialize(rows.join(failed.withColumn("__fails", F.lit(True)), "id", "left").withColumn("draft_failed", F.col("draft_failed") | F.coalesce("__fails", F.lit(False))).drop("__fails"), "run-rows")


@dataclass(frozen=True)
class Run:
    outcomes: DataFrame
    drafts: DataFrame
    records: DataFrame
    stats: DataFrame


def run_batch(hits: DataFrame, pages: DataFrame, history: DataFrame, rules: DataFrame, params: Params, queries: DataFrame | None = None, answers: DataFrame | None = None, covers: DataFrame | None = None, alias: DataFrame | None = None, fails: Callable[[DataFrame], DataFrame] | None = None, lookup: Callable[[DataFrame], DataFrame] | None = None) -> Run:
    """One run. The history is read for URLs, titles and bodies, unless ``lookup`` knows what it has; nothing is written here but intermediates. ``fails`` gives the ids of drafts that fail."""
    spark = hits.sparkSession
    articles = materialize(extract_articles(pages, collect_candidates(hits, queries, params, alias)), "articles")
    answers = spark.createDataFrame([], "id string, content string") if answers is None else answers
    covers = spark.createDataFrame([], "image_url string, media_id string, rejected boolean") if covers is None else covers
    settled = lambda rows: settle_drafts(rows, answers, covers, params.default_cover, params.author)
    done = outcomes(articles, history, rules, None if fails is None else lambda rows: fails(settled(rows)), lookup)
    drafts = settled(articles.join(done.filter("status = 'published'").select("id"), "id", "left_semi"))
    records = article_record(drafts, params.as_of, params.batch_id)  # what is published has no URL of the history, so a rerun adds nothing
    return Run(done, drafts, records, run_stats(done))


def publish(run: Run, path: str, then: Callable[[DataFrame], None] | None = None) -> None:
    """Append the run's records to the history at ``path``; first hand the drafts to ``then``."""
    if then:
        then(run.drafts)
    append_history(run.records, path)
