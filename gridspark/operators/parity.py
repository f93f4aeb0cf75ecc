"""Agreement of several implementations of one operator."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def variant_parity(
    expected: DataFrame, variants: Mapping[str, DataFrame], dims: Sequence[str], value: str, atol: float, rtol: float
) -> DataFrame:
    """Per variant: compared cells, missing cells, largest error and whether all cells are close.

    All variants are stacked and grouped by cell, so the comparison takes one shuffle however many there are.
    """
    stacked = reduce(
        DataFrame.unionByName,
        [df.select(*dims, F.lit(n).alias("variant"), F.col(value).alias("_v")) for n, df in variants.items()],
        expected.select(*dims, F.lit(None).cast("string").alias("variant"), F.col(value).alias("_v")),
    )
    base = F.max(F.when(F.col("variant").isNull(), F.col("_v")))
    cells = stacked.groupBy(*dims).agg(
        F.bool_or(F.col("variant").isNull()).alias("_known"),
        base.alias("_e"),
        *[F.max(F.when(F.col("variant") == n, F.col("_v"))).alias(f"_v_{n}") for n in variants],
        *[F.count(F.when(F.col("variant") == n, 1)).alias(f"_n_{n}") for n in variants],
    )
    pairs = cells.select(
        "_e",
        "_known",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(n).alias("variant"), F.col(f"_v_{n}").alias("v"), F.col(f"_n_{n}").alias("n"))
                    for n in variants
                ]
            )
        ).alias("_p"),
    ).select("_e", "_known", "_p.*")
    error = F.abs(F.col("v") - F.col("_e"))
    both_nan = F.isnan("v") & F.isnan("_e")
    close = both_nan | (error <= F.lit(atol) + F.lit(rtol) * F.abs("_e"))
    ok = F.col("_known") & (F.col("n") == 1) & F.coalesce(close, F.lit(False))
    return pairs.groupBy("variant").agg(
        F.count(F.when(F.col("n") > 0, 1)).alias("cells"),
        F.count(F.when((F.col("n") != 1) | ~F.col("_known"), 1)).alias("unmatched"),
        F.max(F.when(~both_nan, error)).alias("max_error"),
        F.bool_and(ok).alias("close"),
    )


def whole_parity(parts: DataFrame) -> DataFrame:
    """One report from those of :func:`variant_parity` on parts of the cells."""
    return parts.groupBy("variant").agg(
        F.sum("cells").alias("cells"),
        F.sum("unmatched").alias("unmatched"),
        F.max("max_error").alias("max_error"),
        F.bool_and("close").alias("close"),
    )
