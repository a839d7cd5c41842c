"""Corpus pipeline: quality classifier, near-dedup, benchmark decontamination, source mixing, token files.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; :func:`run` writes each stage's rows as Parquet in the shared folder
and reads them back as the next stage's input; what a stage wrote besides goes with it. All stages but the last return the columns of ``documents``, and
further columns of ``docs`` whatever their names.

Defined cases, alike for all stages: null and empty texts are documents of no words; repeated rows and null or repeated ids are rows of their own, except
that of near-duplicates, equal rows among them, one stays; an empty table of documents gives no rows, of labels or benchmark items nothing to drop.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, mixing, neardup, quality, tokens
from tidemark.llm.common import materialize, prepare, scratch, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier rejects go; a text without words has no evidence against it and stays. It is fitted on the rated documents
    of the stage's input; without ratings of two grades nothing is rejected."""
    prepare(spark)
    model = quality.fit(docs, quality.grade_ratings(table(spark, sf_dir, "labels")))
    return quality.keep_good(docs, model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest doc_id (null ids last; then the smallest text hash)."""
    prepare(spark)
    return neardup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs go; items without words have no window."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or dropped so that each source's words come near its target; those without words are repeated as their source is on average,
    rounded down. A null source is a source."""
    prepare(spark)
    return mixing.mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in doc_id order (null ids first), which stay, and per document of them: doc_id, start, n_tokens, ids_crc32."""
    prepare(spark)
    return tokens.encode_to_files(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
    ("token_ids", token_stage),
]

#: Model training, sampling and token ids are outside SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
    return docs
