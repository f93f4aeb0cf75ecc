"""The evaluation of an experiment from raw measurements to scaling results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.ieee import ieee_div
from gridspark.functions.scalars import amdahl_speedup
from gridspark.operators import cube


def evaluate(
    measurements: DataFrame,
    dims: Sequence[str],
    parts: Sequence[str],
    contributors: Sequence[str],
    renames: Mapping[Any, Any],
    removed: Sequence[Any],
    combined: Mapping[str, Sequence[str]],
    runtime: str,
    reference: Any,
    main: str = "impl",
    cores: str = "cores",
) -> DataFrame:
    """Reduce iterations, merge the core dimensions, rename and drop labels, add combined runtimes; then attach the
    speedup, the runtime relative to the reference label, the fitted serial fraction and the speedup it predicts.

    Labels are dropped before anything is aggregated, so the filter reaches the scan of the measurements.
    """
    rows = cube.remove_labels(measurements, main, list(removed), strict=False) if removed else measurements
    results = cube.reduce_iterations(rows, dims, parts)
    results = cube.create_cores_dimension(results, dims, parts, contributors, cores)
    results = cube.rename_labels(results, {main: renames})
    for name, to_add in combined.items():
        results = cube.combine_runtimes(results, name, to_add)
    # one row per label and core count is left: windows share one pass over it
    series = Window.partitionBy(main)
    results = results.withColumns(
        {"_cores": F.min(cores).over(series), "_base": F.min_by(runtime, cores).over(series)}
    ).withColumn("_c", ieee_div(F.col(cores), F.col("_cores")))
    weight = ieee_div(F.col("_c") - 1, F.col("_c"))
    excess = F.col(runtime) - ieee_div(F.col("_base"), F.col("_c"))
    serial = ieee_div(F.sum(excess * weight).over(series), F.col("_base") * F.sum(weight * weight).over(series))
    reference_runtime = F.min(F.when(F.col(main) == reference, F.col(runtime))).over(Window.partitionBy(cores))
    joined = results.withColumn("serial", serial).withColumn("_ref", reference_runtime)
    return joined.select(
        main,
        cores,
        *parts,
        *combined,
        ieee_div(F.col("_base"), F.col(runtime)).alias("speedup"),
        ieee_div(F.col(runtime), F.col("_ref")).alias("relative"),
        "serial",
        amdahl_speedup(F.col("serial"), F.col("_c")).alias("expected"),
    )
