"""Positions, statistics and running sums inside groups of any size, without putting a group into one task.

A group is cut into segments along its order. What one segment has to know of the others is one row per segment, made by an
aggregation with map-side combine; a window over the group's segments works on those rows, and an equi-join by segment hands
the result to the cells, which are never gathered into arrays. Every table takes the same route, whatever its size. Groups
are compared as structs, so a group whose key is null is one too. Rows without a position are spread.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Levels of a segment of a column.
SEGMENT = 1 << 10
#: Segments of the rows of a group that have no position.
SPREAD = 64


class Stat(NamedTuple):
    """A statistic of a group: an aggregate of the rows of one segment, then across the segments."""

    within: Column
    across: Callable[[Column], Column]


def highest(value: Column) -> Stat:
    """Largest value of an expression on the rows; nulls are passed over. A struct compares field by field."""
    return Stat(F.max(value), F.max)


def last(value: Column, dim: str) -> Stat:
    """Value at the highest position."""
    return Stat(F.max_by(value, F.col(dim)), lambda tops: F.max_by(tops, F.col("_seg2")))


def number_of_rows() -> Stat:
    return Stat(F.count(F.lit(1)), F.sum)


def group_of(keys: Sequence[str]) -> Column:
    return F.struct(*keys)


def cut(df: DataFrame, keys: Sequence[str], dim: str, size: int | None = None) -> DataFrame:
    """Add the group ``_k`` and the segment ``_seg`` of every row; missing positions come before all others.

    Rows without a position are spread by their first variable, so that a scan for statistics reads no other column.
    """
    hashed = [c for c, kind in df.dtypes if c not in (*keys, dim) and "map<" not in kind and "variant" not in kind]
    lost = F.lit(-1) - F.pmod(F.xxhash64(F.lit(0), *hashed[:1]), F.lit(SPREAD))
    segment = F.coalesce(F.floor(F.col(dim) / F.lit(size or SEGMENT)).cast("bigint"), lost)
    return df.select("*", group_of(keys).alias("_k"), segment.alias("_seg"))


def across_segments(rows: DataFrame, within: Mapping[str, Column], across: Mapping[str, Column]) -> DataFrame:
    """Attach to the rows of ``cut`` what their segment learns from the others of its group.

    ``within`` are aggregates of one segment; ``across`` are expressions on those, in windows over ``_k2`` by ``_seg2``.
    """
    thin = rows.groupBy(F.col("_k").alias("_k2"), F.col("_seg").alias("_seg2")).agg(*[c.alias(n) for n, c in within.items()])
    known = thin.select("_k2", "_seg2", *[c.alias(n) for n, c in across.items()])
    joined = rows.join(known, (F.col("_k") == F.col("_k2")) & (F.col("_seg") == F.col("_seg2")))
    return joined.drop("_k2", "_seg2")


def with_group_stats(df: DataFrame, keys: Sequence[str], dim: str, stats: Mapping[str, Stat]) -> DataFrame:
    """Attach statistics of each row's group."""
    group = Window.partitionBy("_k2")
    named = across_segments(
        cut(df, keys, dim),
        {f"_s_{n}": s.within for n, s in stats.items()},
        {n: s.across(F.col(f"_s_{n}")).over(group) for n, s in stats.items()},
    )
    return named.select(*df.columns, *stats)


def with_positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str,
    count: str | None = None,
    coarse: Sequence[Column] = (),
) -> DataFrame:
    """0-based position of each row in its group.

    ``coarse`` are expressions that never fall along ``order``: rows that share them form a segment, which is sorted by
    one task, and segments are counted with map-side combine; without them a group is one segment, so leave them out for
    small groups only. Rows that are equal in ``order`` are numbered in any order.
    """
    segment = F.struct(*coarse) if coarse else F.lit(0)
    rows = df.select("*", group_of(keys).alias("_k"), segment.alias("_seg"))
    sizes = rows.groupBy(F.col("_k").alias("_k2"), F.col("_seg").alias("_seg2")).agg(F.count("*").alias("_c"))
    group = Window.partitionBy("_k2")
    earlier = group.orderBy("_seg2").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_c").over(earlier), F.lit(0))
    carry = sizes.select("_k2", "_seg2", before.alias("_before"), F.sum("_c").over(group).cast("bigint").alias("_size"))
    inside = Window.partitionBy("_k", "_seg").orderBy(*order)
    numbered = rows.withColumn("_i", F.row_number().over(inside))
    joined = numbered.join(carry, (F.col("_k") == F.col("_k2")) & (F.col("_seg") == F.col("_seg2")))
    position = (F.col("_before") + F.col("_i") - 1).cast("bigint").alias(name)
    return joined.select(*df.columns, position, *([] if count is None else [F.col("_size").alias(count)]))
