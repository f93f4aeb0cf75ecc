"""Result tables on disk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.operators.cube import config_summary, typed_summary


def save_results(results: DataFrame, experiment: str, path: str) -> None:
    """Store a result table under its experiment's name, replacing only that experiment."""
    (
        results.withColumn("experiment", F.lit(experiment))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("experiment")
        .parquet(path)
    )


def load_results(spark: SparkSession, experiment: str, path: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("experiment") == experiment).drop("experiment")


def save_config(results: DataFrame, dims: Sequence[str], path: str) -> None:
    """The labels of every dimension as JSON lines, one directory per dimension."""
    config_summary(results, dims).write.mode("overwrite").partitionBy("dim").json(path)


def save_typed_config(results: DataFrame, dims: Sequence[str], path: str) -> None:
    """The labels of every dimension as JSON lines in which numbers are numbers and texts are texts."""
    line = F.struct("dim", "place", F.parse_json("label").alias("label"), "scalar")
    typed_summary(results, dims).select(F.to_json(line).alias("value")).write.mode("overwrite").text(path)


def load_typed_config(spark: SparkSession, path: str) -> DataFrame:
    """The stored labels, each a variant of its own type."""
    return spark.read.schema("dim string, place long, label variant, scalar boolean").json(path)
