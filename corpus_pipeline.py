"""Corpus pipeline: quality rules, line dedup, near-copy join, suffix dedup, packing.

Each stage gets the documents that the stage before kept, as a table read from Parquet, and returns documents with the same
columns; the last returns the packing plan. ``n_chars`` follows the text where the table has it. Nulls, empty texts,
repeated rows and extra columns are treated as the operators state in their modules; an empty table gives empty
results in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanloom.llm import common, line_dedup, ngram_join, packing, quality, repeats


def _measured(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the simple rules and the likelihood-ratio threshold."""
    return quality.keep(docs, *quality.fit(docs, common.table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that three or more share; every document stays."""
    return _measured(line_dedup.dedup(docs))


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.dedup(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without words that repeat over 50 words or more; every document stays."""
    return _measured(repeats.dedup(docs, words=True))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and place of every document."""
    return packing.pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", drop_lines),
    ("ngram_join", join_near_copies),
    ("suffix_array_dedup", drop_repeats),
    ("packing", pack),
]

# Likelihood ratios, components and packing are no SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
