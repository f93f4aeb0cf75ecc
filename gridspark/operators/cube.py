"""Result cubes of runtime experiments, kept as long tables: one row per configuration, one column per runtime part.

A missing measurement is NaN. Per-group lookups (base rows, reference rows) are aggregations joined back rather than
windows, so a series of any size is combined on the map side first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions.ieee import NAN, ieee_div, present
from gridspark.operators.ranks import with_positions
from gridspark.operators.reductions import Reduction, expression, reduce_by

#: Column metadata marking a runtime column that combines other ones.
COMBINED = "gridspark.combined"


# ---------------------------------------------------------------- measurements to cubes


def reduce_iterations(
    measurements: DataFrame,
    config: Sequence[str],
    parts: Sequence[str],
    warmup: bool = True,
    reduction: Reduction = "nanmean",
    iteration: str = "iteration",
) -> DataFrame:
    """One row per configuration from its timed iterations, without the warm-up one."""
    rows = measurements.filter(F.col(iteration) > 0) if warmup else measurements
    return reduce_by(rows, config, parts, reduction)


def add_options(df: DataFrame, **values: Any) -> DataFrame:
    """Each row with every combination of the given value lists; a scalar is a list of one."""
    for name, given in values.items():
        options = given if isinstance(given, list) else [given]
        df = df.select("*", F.explode(F.array(*[F.lit(v) for v in options])).alias(name))
    return df


def config_grid(spark: SparkSession, **values: Any) -> DataFrame:
    """Every combination of the given value lists."""
    return add_options(spark.range(1).select(), **values)


def label_grid(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Every combination of the labels that occur per dimension, null labels aside.

    The distinct labels of a dimension are found with map-side combine. Grid rows are spread anew before each dimension
    is added, so that the grid, which is larger than any of its axes, is made by many tasks.
    """
    axes = [df.select(d).where(F.col(d).isNotNull()).distinct() for d in dims]
    grid = axes[0]
    for axis in axes[1:]:
        grid = grid.repartition(*grid.columns).join(axis, how="cross")
    return grid


def result_cube(measurements: DataFrame, dims: Sequence[str], parts: Sequence[str], seq: str) -> DataFrame:
    """Dense cube: all label combinations, NaN where not measured, the last row wins among duplicates."""
    latest = measurements.groupBy(*dims).agg(F.max_by(F.struct(*parts), seq).alias("_m"))
    filled = label_grid(measurements, dims).join(latest, list(dims), "left")
    return filled.select(*dims, *[F.coalesce(f"_m.{p}", F.lit(NAN)).alias(p) for p in parts])


def unpivot_dims(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Distinct ``(dim, label)`` rows; labels as text."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("label")) for d in dims])
    return df.select(*dims).distinct().select(F.inline(pairs)).distinct()


def typed_labels(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Distinct ``(dim, label)`` rows whose labels are JSON texts, so that ``3`` and ``"3"`` differ; null ones are left out.

    Dimensions may have any type, variants too, which hold labels of several types.
    """
    pairs = [F.struct(F.lit(d).alias("dim"), F.to_json(F.col(d).cast("variant")).alias("label")) for d in dims]
    rows = df.select(F.inline(F.array(*pairs))).where(F.col("label").isNotNull() & (F.col("label") != "null"))
    return rows.distinct()


def label_order(label: Column) -> Column:
    """What JSON labels are sorted by: numbers by value and before all others, those by text."""
    value = F.parse_json(label)
    number = F.when(F.schema_of_variant(value).isin("STRING", "BOOLEAN"), None).otherwise(F.try_variant_get(value, "$", "double"))
    return F.struct(number.isNull().alias("other"), number.alias("number"), label.alias("text"))


def typed_summary(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """The JSON labels of each dimension with their 0-based place in its order, flagged scalar where there is only one."""
    labels = typed_labels(df, dims).withColumn("_order", label_order(F.col("label")))
    # numbers fall into segments by size, texts into one for each first letter
    coarse = [F.col("_order.other"), F.floor(F.log2(F.greatest(F.col("_order.number"), F.lit(1.0)))), F.substring("label", 1, 2)]
    segment = [coarse[0], F.when(~coarse[0], coarse[1]), F.when(coarse[0], coarse[2])]
    placed = with_positions(labels, ["dim"], ["_order"], "place", "_n", segment)
    return placed.select("dim", "place", "label", (F.col("_n") == 1).alias("scalar"))


def varying_dims(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    counts = unpivot_dims(df, dims).groupBy("dim").agg(F.count("*").alias("labels"))
    return counts.filter(F.col("labels") > 1)


def config_summary(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """The labels of each dimension, flagged scalar where there is only one."""
    labels = unpivot_dims(df, dims)
    counts = labels.groupBy("dim").agg((F.count("*") == 1).alias("scalar"))
    return labels.join(counts, "dim")


def create_cores_dimension(
    results: DataFrame,
    dims: Sequence[str],
    parts: Sequence[str],
    contributors: Sequence[str],
    cores: str = "cores",
    reduction: Reduction = "min",
) -> DataFrame:
    """Replace the contributing dimensions by their product, reducing equal products."""
    rest = [d for d in dims if d not in contributors]
    product = reduce(Column.__mul__, [F.col(c) for c in contributors]).cast("bigint")
    keyed = results.withColumn(cores, product)
    return reduce_by(keyed, [*rest, cores], parts, reduction)


# ---------------------------------------------------------------- labels and runtime columns


def rename_labels(results: DataFrame, renames: Mapping[str, Mapping[Any, Any] | list[Any]]) -> DataFrame:
    """Rename labels by mapping (others stay) or by a list that replaces the sorted labels one by one."""
    out = results
    for dim, spec in renames.items():
        if isinstance(spec, list):
            # one label more than the list is enough to notice a wrong length
            found = [r[0] for r in out.select(dim).distinct().orderBy(dim).limit(len(spec) + 1).collect()]
            if len(found) != len(spec):
                raise ValueError(f"{len(spec)} new labels given for another number of labels of {dim}")
            spec = dict(zip(found, spec))
        if spec:
            # one label of another type makes all labels text
            same_type = len({type(x) for kv in spec.items() for x in kv}) == 1
            c = F.col(dim) if same_type else F.col(dim).cast("string")
            pairs = spec if same_type else {k: str(v) for k, v in spec.items()}
            mapping = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
            out = out.withColumn(dim, F.coalesce(F.try_element_at(mapping, F.col(dim)), c))
    return out


def remove_labels(results: DataFrame, dim: str, labels: list[Any], strict: bool = True) -> DataFrame:
    """Drop rows with these labels; with ``strict`` an absent label is an error."""
    if strict:
        found = {r[0] for r in results.filter(F.col(dim).isin(labels)).select(dim).distinct().collect()}
        if found != set(labels):
            raise KeyError(f"labels not found in {dim}: {sorted(set(labels) - found)}")
    return results.filter(~F.col(dim).isin(labels))


def combine_runtimes(results: DataFrame, name: str, parts: Sequence[str]) -> DataFrame:
    """Add a runtime column that is the sum of others; NaN if one of them is."""
    if not parts:
        raise ValueError("no runtimes to add")
    total = reduce(Column.__add__, [F.coalesce(F.col(p), F.lit(NAN)) for p in parts])
    return results.withColumn(name, total.alias(name, metadata={COMBINED: True}))


def mark_combined(results: DataFrame, name: str) -> DataFrame:
    return results.withMetadata(name, {COMBINED: True})


def plain_parts(results: DataFrame, parts: Sequence[str]) -> list[str]:
    """The given runtime columns without the combined ones."""
    return [p for p in parts if not results.schema[p].metadata.get(COMBINED)]


# ---------------------------------------------------------------- reductions and series


def marginal(results: DataFrame, main: str, dim: str, parts: Sequence[str], reduction: Reduction = "nanmin") -> DataFrame:
    """Reduce all dimensions but ``main`` and ``dim``."""
    return reduce_by(results, [main, dim], parts, reduction)


def marginal_sets(
    results: DataFrame, main: str, dims: Sequence[str], parts: Sequence[str], reduction: Reduction = "nanmin"
) -> DataFrame:
    """The marginals of all ``dims`` in one pass, as rows ``(main, dim, label, parts)``.

    Spark aggregates are grouping sets; other reductions get each row once for every dimension.
    """
    chosen = expression(reduction)
    if chosen is None:
        labels = [F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("label")) for d in dims]
        rows = results.select(main, *parts, F.inline(F.array(*labels)))
        return reduce_by(rows, [main, "dim", "label"], parts, reduction)
    sets = [[F.col(main), F.col(d)] for d in dims]
    grouped = results.groupingSets(sets, F.col(main), *[F.col(d) for d in dims]).agg(
        *[F.grouping(d).alias(f"_g_{d}") for d in dims],
        *[chosen(F.col(p)).alias(p, metadata=results.schema[p].metadata) for p in parts],
    )
    name, label = F.lit(None).cast("string"), F.lit(None).cast("string")
    for d in dims:
        here = F.col(f"_g_{d}") == 0
        name = F.when(here, F.lit(d)).otherwise(name)
        label = F.when(here, F.col(d).cast("string")).otherwise(label)
    return grouped.select(main, name.alias("dim"), label.alias("label"), *parts)


def unpivot_parts(results: DataFrame, keys: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """Rows ``(keys, rt_type, runtime)``."""
    pairs = F.array(*[F.struct(F.lit(p).alias("rt_type"), F.col(p).alias("runtime")) for p in parts])
    return results.select(*keys, F.inline(pairs))


def complete_series(results: DataFrame, keys: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """Long rows of those runtime types that have a value everywhere."""
    long = unpivot_parts(results, keys, parts)
    whole = results.agg(*[F.coalesce(F.bool_and(present(F.col(p))), F.lit(False)).alias(p) for p in parts])
    ok = unpivot_parts(whole, [], parts).filter("runtime").select("rt_type")
    return long.join(F.broadcast(ok), "rt_type", "left_semi")  # at most one row per runtime column


def sort_series(results: DataFrame, main: str, dim: str) -> DataFrame:
    return results.orderBy(main, dim)


def concat_dim(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def series_base(results: DataFrame, series: Sequence[str], dim: str, part: str) -> DataFrame:
    """First value of each series along ``dim`` and where it is."""
    return results.groupBy(*series).agg(
        F.min(dim).alias(f"base_{dim}"), F.min_by(part, dim).alias("base_runtime")
    )


def speedup(
    results: DataFrame, series: Sequence[str], dim: str, part: str, base: DataFrame | None = None
) -> DataFrame:
    """Base runtime over runtime; the base is the first value of the series unless given."""
    base = series_base(results, series, dim, part).select(*series, "base_runtime") if base is None else base
    own = results.select(*series, dim, part)
    # without a series there is one base
    joined = own.join(base, list(series)) if series else own.withColumn("base_runtime", base.select(F.max("base_runtime")).scalar())
    return joined.select(*series, dim, ieee_div(F.col("base_runtime"), F.col(part)).alias("speedup"))


def relative_runtime(results: DataFrame, main: str, dim: str, part: str, reference: Any = None) -> DataFrame:
    """Runtime over the runtime of the reference label at the same position of ``dim``.

    The reference is the first label unless given. With one label only there is nothing to compare with, and runtimes
    stay as they are.
    """
    # one aggregate over (main, dim), the smallest of its tables that the rest needs
    least = results.groupBy(dim, main).agg(F.min(part).alias("_least"))
    if reference is None:
        found = least.groupBy(dim).agg(F.min_by("_least", main).alias("_ref"), F.min(main).alias("_at"))
    else:
        found = least.where(F.col(main) == F.lit(reference)).select(dim, F.col("_least").alias("_ref"), F.col(main).alias("_at"))
    ends = results.agg(F.struct(F.min(main).alias("first"), F.max(main).alias("last"))).scalar()
    joined = results.select(main, dim, part).join(found, dim, "left").withColumn("_ends", ends)
    # without a given reference a position that lacks the first label has none
    given = F.lit(True) if reference is not None else F.col("_at") == F.col("_ends.first")
    ratio = ieee_div(F.col(part), F.when(given, F.col("_ref")))
    relative = F.when(F.col("_ends.first") == F.col("_ends.last"), F.col(part)).otherwise(ratio)
    return joined.select(main, dim, relative.alias("relative"))


def linear_baseline(results: DataFrame, dim: str) -> DataFrame:
    """Perfect scaling: each tick over the first one."""
    first = results.agg(F.min(dim)).scalar()
    return results.select(dim).distinct().select(dim, ieee_div(F.col(dim), first).alias("linear"))


def runtime_shares(results: DataFrame, keys: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """Share of each plain runtime part in the measurement's total, with the sum of the shares before it.

    Parts are columns, so totals and offsets are expressions on one row. Incomplete measurements are dropped.
    """
    plain = plain_parts(results, parts)
    whole = results.filter(reduce(Column.__and__, [present(F.col(p)) for p in plain]))
    total = reduce(Column.__add__, [F.col(p) for p in plain])
    entries = []
    below = F.lit(0.0)
    for i, p in enumerate(plain):
        share = ieee_div(F.col(p), total)
        entries.append(
            F.struct(
                F.lit(p).alias("rt_type"), F.lit(i).alias("pos"), share.alias("share"), below.alias("offset")
            )
        )
        below = below + share
    return whole.select(*keys, F.inline(F.array(*entries)))


def axis_kind(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """``bar`` for a dimension with labels that are no numbers, ``line`` otherwise."""
    labels = unpivot_dims(df, dims)
    numeric = F.bool_and(F.col("label").try_cast("double").isNotNull())
    return labels.groupBy("dim").agg(F.when(numeric, "line").otherwise("bar").alias("kind"))
