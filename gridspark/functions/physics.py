"""Point-wise formulas of the column diagnostics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridspark.functions.ieee import ieee_div

# Physical constants.
GRAVITY = 9.80665
R_DRY = 287.05
R_VAPOUR = 461.51
CP_DRY = 1005.0
P_SURFACE = 1.0e5

KAPPA = R_DRY / CP_DRY
VAPOUR_FACTOR = R_VAPOUR / R_DRY - 1.0


def thetav(p: Column, t: Column, qv: Column) -> Column:
    """Virtual potential temperature of one cell."""
    exner = F.pow(ieee_div(F.lit(P_SURFACE), p), F.lit(KAPPA))
    moisture = F.lit(1.0) + ieee_div(F.lit(VAPOUR_FACTOR) * qv, F.lit(1.0) - qv)
    return exner * t * moisture


def wind_sq(u: Column, v: Column) -> Column:
    return u * u + v * v


def richardson(height: Column, anomaly: Column, levels: Column, theta_sum: Column, wind2: Column) -> Column:
    """Bulk Richardson number from the height above ground, the anomaly against the last level, the number
    of levels from here to the last one, the running theta sum and the squared wind."""
    return ieee_div(F.lit(GRAVITY) * height * anomaly * levels, theta_sum * wind2)
