"""Corpus pipeline: stages that clean and mix the documents, each written as Parquet and read again by the next.

``STAGES`` lists (name, function); every function takes (spark, docs, sf_dir) and works on all rows that its predecessor
kept. All but the last return the columns of documents (others are carried along); the last returns the mix. Nulls, empty
texts, repeated rows and empty tables are treated as the operators of ``gridspark.llm`` define it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm import decontamination, jaccard, mixing, pii, quality
from gridspark.llm.tables import small_batches, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _in_small_batches(stage: Stage) -> Stage:
    """The stages share their executors, so each hands texts to Python in batches of bounded size."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


@_in_small_batches
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@_in_small_batches
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    return jaccard.representatives(docs)


@_in_small_batches
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of a benchmark item."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


@_in_small_batches
def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the names of their kinds in place of personal data; ``n_chars`` follows the text."""
    cleaned = docs.withColumn("text", pii.redact(pii.train(docs), docs["text"]))
    return cleaned.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars"))


@_in_small_batches
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is copied, so that the sources come near their target weights."""
    return mixing.mix(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("mixing", mixed),
]
#: Learned scores and random rounding have no SQL; tests hold the stages against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
