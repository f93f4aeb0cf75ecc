"""Run operator variants over layouts as Spark jobs and time their stages."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from time import perf_counter
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from gridspark.operators.cube import reduce_iterations
from gridspark.operators.structure import perturb
from gridspark.sources.fields import discard

#: Stage times of one run.
PARTS = ("full_rt", "input_loading", "compute", "graph_construction", "optimization", "serialization")


def measure(load: Callable[[], DataFrame], operator: Callable[[DataFrame], DataFrame], eps: float) -> dict[str, float]:
    """Time one run: build the input, build the plan, optimise it, plan its stages, compute into a sink.

    ``eps`` is added to every variable, so that a run cannot profit from results kept by an earlier one.
    """
    marks = [perf_counter()]
    cells = load()
    marks.append(perf_counter())
    variables = [f.name for f in cells.schema.fields if f.dataType.typeName() == "double"]
    out = operator(perturb(cells, variables, eps))
    marks.append(perf_counter())
    query = out._jdf.queryExecution()
    query.optimizedPlan()
    marks.append(perf_counter())
    query.executedPlan()
    marks.append(perf_counter())
    discard(out)
    marks.append(perf_counter())
    load_t, build_t, opt_t, plan_t, run_t = [b - a for a, b in zip(marks, marks[1:])]
    return dict(zip(PARTS, (marks[-1] - marks[0], load_t, run_t, build_t, opt_t, plan_t)))


def measure_runtimes(
    spark: SparkSession,
    operators: Mapping[str, Callable[[DataFrame], DataFrame]],
    inputs: Mapping[str, Callable[[], DataFrame]],
    iterations: int = 5,
    warmup: bool = True,
) -> DataFrame:
    """Raw measurements of every operator on every input: rows ``(impl, layout, iteration, stage times)``."""
    rows: list[tuple[Any, ...]] = []
    for impl, operator in operators.items():
        for layout, load in inputs.items():
            for i in range(iterations + warmup):
                times = measure(load, operator, 1.0e-9 * (i + 1))
                rows.append((impl, layout, i, *[times[p] for p in PARTS]))
    times_schema = ", ".join(f"{p} double" for p in PARTS)
    return spark.createDataFrame(rows, f"impl string, layout string, iteration bigint, {times_schema}")


def sweep(
    spark: SparkSession,
    operators: Mapping[str, Callable[[DataFrame], DataFrame]],
    inputs: Mapping[str, Callable[[], DataFrame]],
    iterations: int = 5,
    warmup: bool = True,
    reduction: str = "nanmean",
    parts: Sequence[str] = PARTS,
) -> DataFrame:
    """One row per configuration, its iterations reduced."""
    raw = measure_runtimes(spark, operators, inputs, iterations, warmup)
    return reduce_iterations(raw, ["impl", "layout"], parts, warmup, reduction)
