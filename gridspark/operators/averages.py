"""Means over one dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.functions.ieee import nan_mean


def avg_dim(df: DataFrame, variable: str, keep: Sequence[str]) -> DataFrame:
    """Mean over the dimensions that are not kept. NaN is skipped; without other values the mean is NaN."""
    return df.groupBy(*keep).agg(nan_mean(F.col(variable)).alias(variable))


def avg_split(df: DataFrame, variable: str, dim: str, size: int, keep: Sequence[str]) -> DataFrame:
    """Mean of the means of the two halves of ``dim``; NaN is skipped, a half without other values is NaN."""
    low = F.col(dim) < size // 2
    halves = df.groupBy(*keep).agg(
        nan_mean(F.when(low, F.col(variable))).alias("_low"),
        nan_mean(F.when(~low, F.col(variable))).alias("_high"),
    )
    return halves.select(*keep, ((F.col("_low") + F.col("_high")) / 2).alias(variable))
