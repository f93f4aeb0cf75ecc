"""Variable selection, dimension order, positional slicing and coordinates of cell tables.

A cell table has one row per grid position: dimension columns hold 0-based positions, variables are double columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.operators.ranks import highest, with_group_stats


def select_vars(df: DataFrame, dims: Sequence[str], names: Sequence[str]) -> DataFrame:
    return df.select(*dims, *names)


def drop_vars(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*names)


def rename_dims(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def transpose(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Store cells in the given dimension order: leading columns, range partitions and sort order follow it."""
    rest = [c for c in df.columns if c not in dims]
    return df.select(*dims, *rest).repartitionByRange(*dims).sortWithinPartitions(*dims)


def isel(df: DataFrame, dim: str, index: int, group: Sequence[str]) -> DataFrame:
    """All rows at one position along ``dim``; a negative index counts from the end of each column."""
    if index >= 0:
        return df.filter(F.col(dim) == index)
    counted = with_group_stats(df, group, dim, {"_last": highest(F.col(dim))})
    return counted.filter(F.col(dim) == F.col("_last") + (index + 1)).drop("_last")


def isel_range(df: DataFrame, dim: str, start: int, stop: int) -> DataFrame:
    """Half-open range of positions, renumbered from 0."""
    kept = df.filter((F.col(dim) >= start) & (F.col(dim) < stop))
    return kept.withColumn(dim, F.col(dim) - start)


def isel_reverse(df: DataFrame, dim: str, group: Sequence[str]) -> DataFrame:
    counted = with_group_stats(df, group, dim, {"_last": highest(F.col(dim))})
    return counted.withColumn(dim, F.col("_last") - F.col(dim)).drop("_last")


def drop_last(df: DataFrame, dim: str, group: Sequence[str]) -> DataFrame:
    """Remove the last position of each column."""
    counted = with_group_stats(df, group, dim, {"_last": highest(F.col(dim))})
    return counted.filter(F.col(dim) < F.col("_last")).drop("_last")


def adjust_dims(df: DataFrame, have: Sequence[str], want: Sequence[str]) -> DataFrame:
    """Drop dimensions of size 1, add missing ones as position 0 and order the columns.

    Dropping a longer dimension is an error of the query: its extent, one row with map-side combine, is checked as part
    of the plan.
    """
    surplus = [d for d in have if d not in want]
    missing = {d: F.lit(0).cast("bigint") for d in want if d not in have}
    variables = [c for c in df.columns if c not in have]
    out = df
    for d in surplus:
        longer = df.select((F.coalesce(F.min(d) != F.max(d), F.lit(False))).alias("_l")).select("_l").scalar()
        problem = F.raise_error(F.lit(f"cannot drop dimension {d}: its size is larger than 1")).cast("boolean")
        out = out.filter(F.when(longer, problem).otherwise(F.lit(True)))
    return out.drop(*surplus).withColumns(missing).select(*want, *variables)


def drop_coords(df: DataFrame, coords: Sequence[str]) -> DataFrame:
    return df.drop(*coords)


def perturb(df: DataFrame, variables: Sequence[str], eps: float) -> DataFrame:
    """Add one constant to every variable, so that a cached result cannot be reused."""
    return df.withColumns({v: F.col(v) + F.lit(eps) for v in variables})
