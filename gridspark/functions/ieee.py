"""IEEE-754 division and NaN-aware aggregates (Spark's ANSI mode raises on ``x / 0``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def ieee_div(num: Column, den: Column) -> Column:
    """``num / den`` giving inf, -inf or NaN for a zero divisor instead of an error."""
    return F.when(den == 0, num * F.pow(den, F.lit(-1.0))).otherwise(num / den)


def not_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def nan_mean(c: Column) -> Column:
    """Mean of the non-NaN values, NaN if there is none."""
    return F.coalesce(F.avg(not_nan(c)), F.lit(NAN))


def nan_min(c: Column) -> Column:
    """Smallest non-NaN value, NaN if there is none."""
    return F.coalesce(F.min(not_nan(c)), F.lit(NAN))


def nan_max(c: Column) -> Column:
    return F.coalesce(F.max(not_nan(c)), F.lit(NAN))


def strict_min(c: Column) -> Column:
    """Minimum that is NaN as soon as one value is NaN or missing."""
    missing = F.bool_or(c.isNull() | F.isnan(c))
    return F.when(missing, F.lit(NAN)).otherwise(F.min(c))


def strict_mean(c: Column) -> Column:
    return F.coalesce(F.avg(F.coalesce(c, F.lit(NAN))), F.lit(NAN))


#: Reductions selectable by name.
REDUCTIONS = {
    "nanmean": nan_mean,
    "nanmin": nan_min,
    "nanmax": nan_max,
    "min": strict_min,
    "mean": strict_mean,
}


def present(c: Column) -> Column:
    """True where a measurement exists (neither null nor NaN)."""
    return c.isNotNull() & ~F.isnan(c)
