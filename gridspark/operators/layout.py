"""Chunk layouts: assignment of cells to chunks, physical re-chunking and comparison of layout tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions import chunks as ch


NUMBERS_PER_BLOCK = 1 << 16


def with_chunks(cells: DataFrame, chunks: Mapping[str, int | list[int]]) -> DataFrame:
    """Add ``chunk_<dim>`` for each specified dimension; a narrow projection."""
    return cells.withColumns({f"chunk_{d}": ch.chunk_of(F.col(d), spec) for d, spec in chunks.items()})


def same_chunks(first: int | list[int] | str | None, second: int | list[int] | str | None, size: int | None = None) -> bool:
    """Whether two specifications of one dimension give the same chunks; ``None`` and ``auto`` match anything.

    With the dimension's ``size``, lists and numbers compare as well, as do ``-1`` and numbers of at least the size.
    """
    if any(s is None or s == "auto" for s in (first, second)):
        return True

    def listed(spec: int | list[int]) -> list[int] | int:
        if isinstance(spec, (list, tuple)):
            return list(spec)
        if size is None:
            return spec
        step = size if spec == -1 else spec
        return [min(step, size - s) for s in range(0, size, step)] if size else []

    return listed(first) == listed(second)


def rechunk(
    cells: DataFrame,
    chunks: Mapping[str, int | list[int]],
    current: Mapping | None = None,
    sizes: Mapping[str, int] | None = None,
) -> DataFrame:
    """Place the cells of a chunk together, for storage; skipped if ``current`` gives the same chunks in every dimension
    (of the given ``sizes``, if known).

    ``rebalance`` lets the adaptive planner split an oversized chunk over several tasks and join small ones.
    """
    out = with_chunks(cells, chunks)
    if current is not None and all(d in current and same_chunks(s, current[d], (sizes or {}).get(d)) for d, s in chunks.items()):
        return out
    return out.hint("rebalance", *[f"chunk_{d}" for d in chunks])


def explode_chunks(layouts: DataFrame, keys: Sequence[str], spec: Column, dim_size: Column) -> DataFrame:
    """One row per chunk of each layout: number, start and size.

    Numbers are expanded in blocks, so a dimension with very many chunks never becomes one long array.
    """
    zero, block = F.lit(0).cast("bigint"), F.lit(NUMBERS_PER_BLOCK).cast("bigint")
    step = F.when(spec == -1, dim_size).otherwise(spec).cast("bigint")
    last = ch.chunk_count(spec, dim_size) - 1
    # a dimension of size 0 has no chunks
    blocks = layouts.filter(spec.isNotNull() & (last >= 0) & (dim_size > 0)).select(
        *keys,
        step.alias("_step"),
        dim_size.cast("bigint").alias("_size"),
        last.alias("_last"),
        F.explode(F.sequence(zero, last, block)).alias("_from"),
    )
    numbers = F.sequence(F.col("_from"), F.least(F.col("_from") + block - 1, F.col("_last")))
    rows = blocks.select(*keys, "_step", "_size", F.explode(numbers).alias("chunk_idx"))
    start = F.col("chunk_idx") * F.col("_step")
    return rows.select(
        *keys, "chunk_idx", start.alias("start"), F.least(F.col("_step"), F.col("_size") - start).alias("size")
    )


def chunk_bounds(layouts: DataFrame, keys: Sequence[str], sizes: str) -> DataFrame:
    """One row per chunk of layouts that list their chunk sizes: ``chunk_idx``, ``start`` and ``stop``.

    The ends are running sums over rows, so a dimension with very many chunks costs no more than its chunks.
    """
    rows = layouts.select(*keys, F.posexplode(sizes).alias("_i", "_n"))
    upto = Window.partitionBy(*keys).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("_n").cast("bigint")).over(upto)
    ends = rows.select(*keys, F.col("_i").cast("bigint").alias("chunk_idx"), stop.alias("stop"), "_n")
    return ends.select(*keys, "chunk_idx", (F.col("stop") - F.col("_n")).alias("start"), "stop")


def assign_by_layout(cells: DataFrame, layouts: DataFrame, keys: Sequence[str], sizes: str, dim: str) -> DataFrame:
    """Add ``chunk_<dim>`` from the chunk sizes that the layout of each cell lists; null beyond the last chunk.

    Positions and chunks meet in bins as wide as the layout's mean chunk: an equi-join on layout and bin, then a comparison
    with the few chunks of the bin. A layout's cells are spread over its bins. Sizes of 0 are chunks without positions.
    """
    keys = list(keys)
    bounds = chunk_bounds(layouts, keys, sizes).where("stop > start")
    total = F.aggregate(F.col(sizes), F.lit(0).cast("bigint"), lambda a, n: a + n)
    widths = layouts.select(*keys, F.greatest(F.ceil(total / F.greatest(F.size(sizes), F.lit(1))), F.lit(1)).cast("bigint").alias("_width"))
    sized = bounds.join(widths, keys)

    def bin_of(position: Column) -> Column:
        return F.call_function("div", position, F.col("_width"))

    spread = F.explode(F.sequence(bin_of(F.col("start")), bin_of(F.col("stop") - 1)))
    binned = sized.select(*[F.col(k).alias(f"_l_{k}") for k in keys], "chunk_idx", "start", "stop", spread.alias("_chunk_bin"))
    placed = cells.join(widths, keys, "left").withColumn("_bin", bin_of(F.col(dim)))
    same = reduce(Column.__and__, [F.col(k) == F.col(f"_l_{k}") for k in keys], F.col("_bin") == F.col("_chunk_bin"))
    inside = (F.col(dim) >= F.col("start")) & (F.col(dim) < F.col("stop"))
    return placed.join(binned, same & inside, "left").select(*cells.columns, F.col("chunk_idx").alias(f"chunk_{dim}"))


def all_over_dims(pairs: DataFrame, keys: Sequence[str], test: Column, name: str) -> DataFrame:
    """A per-dimension test that must hold for each dimension of a layout pair."""
    return pairs.groupBy(*keys).agg(F.bool_and(test).alias(name))


def complete_specs(layouts: DataFrame, keys: Sequence[str], dims: Sequence[str]) -> DataFrame:
    """One numeric specification per layout and dimension of ``dims``; missing or undecided ones are ``-1``.

    ``layouts`` has rows ``(keys, dim, spec)``. Dimensions are known names, so they become columns of one
    aggregation and no table of combinations is built.
    """
    wide = layouts.groupBy(*keys).agg(*[F.max(F.when(F.col("dim") == d, F.col("spec"))).alias(d) for d in dims])
    named = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("spec")) for d in dims]))
    rows = wide.select(*keys, named.alias("_e"))
    return rows.select(*keys, F.col("_e.dim").alias("dim"), F.coalesce("_e.spec", F.lit(-1).cast("bigint")).alias("spec"))
