"""Regression and scaling models over series of runtimes. All fits are one aggregation with map-side combine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.functions.ieee import NAN, ieee_div
from gridspark.functions.scalars import amdahl_speedup


def lin_reg(df: DataFrame, series: Sequence[str], x: str, y: str) -> DataFrame:
    """Intercept ``alpha`` and slope ``beta`` of least squares per series (all rows if ``series`` is empty); NaN where
    no line is determined."""
    fits = {"alpha": F.regr_intercept(y, x), "beta": F.regr_slope(y, x)}
    return df.groupBy(*series).agg(*[F.coalesce(fit, F.lit(NAN)).alias(name) for name, fit in fits.items()])


def power_law_fit(df: DataFrame, series: Sequence[str], scale: str, value: str) -> DataFrame:
    """``value = alpha * scale ** beta`` by regression of the logarithms."""
    logs = df.select(*series, F.ln(scale).alias("_x"), F.ln(value).alias("_y"))
    return lin_reg(logs, series, "_x", "_y").withColumn("alpha", F.exp("alpha"))


def serial_fraction(
    df: DataFrame, series: Sequence[str], cores: str, runtime: str, base: DataFrame | None = None
) -> DataFrame:
    """Serial fraction by the closed-form least-squares fit of Amdahl's law; not clamped to [0, 1].

    ``base`` has columns ``(series, base_cores, base_runtime)``; by default the first core count of each series.
    """
    series = list(series)
    if base is None:
        base = df.groupBy(*series).agg(
            F.min(cores).alias("base_cores"), F.min_by(runtime, cores).alias("base_runtime")
        )
    if series:
        joined = df.join(base, series)
    else:
        joined = df.withColumns({c: base.select(c).scalar() for c in ("base_cores", "base_runtime")})
    c = ieee_div(F.col(cores), F.col("base_cores"))
    w = ieee_div(c - 1, c)
    return joined.groupBy(*series, "base_runtime").agg(
        F.sum((F.col(runtime) - ieee_div(F.col("base_runtime"), c)) * w).alias("_num"), F.sum(w * w).alias("_den")
    ).select(*series, ieee_div(F.col("_num"), F.col("base_runtime") * F.col("_den")).alias("serial"))


def scaling_fit_error(df: DataFrame, series: Sequence[str], threads: str, runtime: str) -> DataFrame:
    """Scaling rate and factor of ``log(runtime)`` over ``log(threads)`` and the fit's mean relative error."""
    logs = df.select(*series, F.ln(threads).alias("_x"), F.ln(runtime).alias("_y"))
    fit = lin_reg(logs, series, "_x", "_y")
    joined = logs.join(fit, list(series))
    error = F.abs(ieee_div(F.col("_y") - (F.col("alpha") + F.col("beta") * F.col("_x")), F.col("_y")))
    return joined.groupBy(*series, "alpha", "beta").agg(F.avg(error).alias("error")).select(
        *series, (-F.col("beta")).alias("rate"), F.col("alpha").alias("factor"), "error"
    )


def scaling_curve(
    df: DataFrame, series: Sequence[str], cores: str, runtime: str, points: int = 100
) -> DataFrame:
    """The fitted Amdahl curve of each series on evenly spaced core counts."""
    fits = serial_fraction(df, series, cores, runtime)
    span = df.groupBy(*series).agg(F.min(cores).alias("_x0"), F.max(cores).alias("_x1"))
    grid = fits.join(span, list(series)).select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    x = F.col("_x0") + (F.col("_x1") - F.col("_x0")) * F.col("point") / F.lit(points - 1)
    placed = grid.withColumn("x", x)
    y = amdahl_speedup(F.col("serial"), ieee_div(F.col("x"), F.col("_x0")))
    return placed.select(*series, F.col("point").cast("bigint").alias("point"), "x", y.alias("speedup"))
