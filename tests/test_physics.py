"""Column diagnostics on constant columns with known results, on random ragged columns and on edge cases."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.functions import physics as phys
from gridspark.operators import physics, ranks, structure
from gridspark.operators.parity import variant_parity
from gridspark.sources import fields

KEYS = ["x", "y"]
CELL = [*KEYS, "z"]
SCHEMA = "x bigint, y bigint, z bigint, p double, t double, qv double, u double, v double, hhl double, hsurf double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def constant_columns(spark, levels, hhl=3.0, hsurf=1.5):
    rows = [
        (x, y, z, 1023.4, 126.3 if z == levels - 1 else 127.3, 0.3, 42.0, 69.0, hhl, hsurf)
        for x in range(2)
        for y in range(2)
        for z in range(levels)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def random_columns(spark, depths, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for c, n in enumerate(depths):
        ground = float(rng.uniform(0, 100))
        for z in range(n):
            p, t, qv, u, v = rng.uniform([2e4, 200, 0, -20, 1], [1e5, 300, 0.02, 20, 10]).tolist()
            rows.append((c, c % 3, z, p, t, qv, u, v, ground + 50.0 * (n - z), ground))
    return spark.createDataFrame(rows, SCHEMA)


def theta_of(p, t, qv):
    return (1e5 / p) ** (287.05 / 1005.0) * t * (1 + (461.51 / 287.05 - 1) * qv / (1 - qv))


def brute_brn(rows, aligned=False):
    """The formula, column by column, level by level."""
    columns = {}
    for r in rows:
        columns.setdefault((r.x, r.y), []).append(r)
    out = {}
    for key, col in columns.items():
        col.sort(key=lambda r: r.z)
        theta = [theta_of(r.p, r.t, r.qv) for r in col]
        n = len(col)
        for z, r in enumerate(col):
            s = sum(theta[z:]) if aligned else sum(theta[n - 1 - k] for k in range(z + 1))
            num = 9.80665 * (r.hhl - r.hsurf) * (theta[z] - theta[-1]) * (n - z)
            out[(*key, z)] = num / (s * (r.u**2 + r.v**2))
    return out


def by_cell(df, name):
    return {(r.x, r.y, r.z): r[name] for r in df.collect()}


@pytest.mark.parametrize("variant", physics.THETAV_VARIANTS)
def test_thetav_constant(spark, variant):
    got = by_cell(physics.THETAV_VARIANTS[variant](constant_columns(spark, 8), CELL), "thetav")
    assert len(got) == 32
    for (_, _, z), v in got.items():
        expected = 589.2658124346763 if z == 7 else 593.9314166503111
        assert v == pytest.approx(expected, rel=1e-14)


@pytest.mark.parametrize("variant", physics.BRN_VARIANTS)
@pytest.mark.parametrize("levels", [8, 16])
def test_brn_constant(spark, variant, levels):
    got = by_cell(physics.BRN_VARIANTS[variant](constant_columns(spark, levels), KEYS), "brn")
    tv, top = theta_of(1023.4, 127.3, 0.3), theta_of(1023.4, 126.3, 0.3)
    sums = np.cumsum([top] + [tv] * (levels - 1))
    expected = 9.80665 * 1.5 * (tv - top) * np.arange(levels, 0, -1.0) / (sums * (42.0**2 + 69.0**2))
    expected[-1] = 0.0
    assert len(got) == 4 * levels
    for (_, _, z), v in got.items():
        assert v == pytest.approx(expected[z], abs=1e-15)
    if levels == 8:
        assert got[(0, 0, 0)] == pytest.approx(1.427966618e-4, rel=1e-9)


@pytest.mark.parametrize("variant", physics.BRN_VARIANTS)
def test_brn_zero_height(spark, variant):
    got = by_cell(physics.BRN_VARIANTS[variant](constant_columns(spark, 8, 0.2, 0.2), KEYS), "brn")
    assert set(got.values()) == {0.0}


@pytest.mark.parametrize("variant", physics.BRN_VARIANTS)
@pytest.mark.parametrize("aligned", [False, True])
def test_brn_ragged(spark, variant, aligned):
    """Depths of one, odd and even numbers of levels."""
    cells = random_columns(spark, [1, 2, 3, 7, 8, 13, 1, 5])
    expected = brute_brn(cells.collect(), aligned)
    got = by_cell(physics.BRN_VARIANTS[variant](cells, KEYS, aligned), "brn")
    assert got.keys() == expected.keys()
    for k, v in expected.items():
        assert got[k] == pytest.approx(v, rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("variant", physics.BRN_VARIANTS)
def test_brn_deep_columns(spark, small_groups, variant):
    """Columns deeper than one task may hold, beside ordinary ones."""
    cells = random_columns(spark, [130, 3, 41, 40, 1])
    expected = brute_brn(cells.collect())
    got = by_cell(physics.BRN_VARIANTS[variant](cells, KEYS), "brn")
    assert got.keys() == expected.keys()
    for k, v in expected.items():
        assert got[k] == pytest.approx(v, rel=1e-9, abs=1e-12)


def test_brn_zero_wind(spark):
    """Zero wind divides by zero: infinite, or NaN at the last level where the anomaly is zero too."""
    cells = constant_columns(spark, 4).withColumns({"u": F.lit(0.0), "v": F.lit(0.0)})
    for name, variant in physics.BRN_VARIANTS.items():
        for (_, _, z), v in by_cell(variant(cells, KEYS), "brn").items():
            assert math.isnan(v) if z == 3 else v == math.inf, name


def test_thetav_ieee(spark):
    rows = [(0, 0, 0, 0.0, 300.0, 0.0), (0, 0, 1, -1.0, 300.0, 0.0), (0, 0, 2, 1e5, 300.0, 1.0)]
    df = spark.createDataFrame(rows, "x bigint, y bigint, z bigint, p double, t double, qv double")
    got = by_cell(physics.thetav(df, CELL), "thetav")
    assert got[(0, 0, 0)] == math.inf and math.isnan(got[(0, 0, 1)]) and got[(0, 0, 2)] == math.inf


def test_repeated_brn_is_nan_from_second_round(spark):
    cells = random_columns(spark, [1, 4, 9])
    assert not any(math.isnan(v) for v in by_cell(physics.repeated_brn(cells, KEYS, 1), "brn").values())
    for n in (2, 6):
        assert all(math.isnan(v) for v in by_cell(physics.repeated_brn(cells, KEYS, n), "brn").values())


def test_repeated_brn_of_profiles(spark):
    cells = random_columns(spark, [1, 4, 9])
    profiles = physics.to_profiles(cells, KEYS, ("p", "t", "qv", "u", "v", "hhl"), ("hsurf",))
    once = physics.from_profiles(physics.repeated_brn_of_profiles(profiles, KEYS, 1), KEYS, "brn")
    got = by_cell(once, "brn")
    for k, v in brute_brn(cells.collect()).items():
        assert got[k] == pytest.approx(v, rel=1e-9, abs=1e-12)
    twice = physics.from_profiles(physics.repeated_brn_of_profiles(profiles, KEYS, 2), KEYS, "brn")
    assert all(math.isnan(v) for v in by_cell(twice, "brn").values())


def test_iterate_cuts_lineage(spark):
    """More steps than fit between two written states."""
    cells = random_columns(spark, [2, 3])
    got = by_cell(physics.iterate_thetav(cells, CELL, 9), "thetav")
    for r in cells.collect():
        t = r.t
        for _ in range(9):
            t = theta_of(r.p, t, r.qv)
        assert got[(r.x, r.y, r.z)] == pytest.approx(t, rel=1e-10)


@pytest.mark.parametrize("segment", [None, 1, 2, 5, 100])
def test_reversed_cumsum(spark, segment):
    cells = random_columns(spark, [1, 2, 7, 12])
    got = by_cell(physics.vertical_cumsum_rev(cells, F.col("t"), KEYS, "s", segment), "s")
    columns = {}
    for r in cells.collect():
        columns.setdefault((r.x, r.y), {})[r.z] = r.t
    for key, col in columns.items():
        run = np.cumsum([col[z] for z in reversed(range(len(col)))])
        for z in col:
            assert got[(*key, z)] == pytest.approx(run[z], rel=1e-12)


def test_flagship_gathers_cells_twice(spark, tmp_path):
    """Cells are exchanged by segment and by pair of levels; what else is exchanged has one row per segment, and no
    window orders the cells of a whole column."""
    grid = fields.index_grid(spark, {"x": 4, "y": 4, "z": 8})
    fields.synthetic_fields(grid, CELL, [n.lower() for n in fields.INPUT_NAMES]).write.parquet(str(tmp_path / "c"))
    df = physics.brn(spark.read.parquet(str(tmp_path / "c")), KEYS)
    df.collect()
    tree = df._jdf.queryExecution().executedPlan().toString()
    final = tree.split("+- == Initial Plan ==")[0]
    assert "Window" in final and "_pair" in final
    for line in final.splitlines():
        if "Window [" in line and "_suffix" in line:
            assert "_seg" in line or "_pair" in line
    scans = sorted((r.split("ReadSchema")[1] for r in final.splitlines() if "FileScan" in r), key=len)
    assert len(scans) == 2, tree
    assert "hhl" not in scans[0] and "u:" not in scans[0]  # the second reads theta's inputs only, for one row per segment


def test_parity_reports_a_wrong_variant(spark):
    cells = random_columns(spark, [3, 4])
    good = physics.brn_windows(cells, KEYS)
    wrong = good.withColumn("brn", F.when(F.col("z") == 1, F.col("brn") + 1).otherwise(F.col("brn")))
    missing = good.filter("z > 0")
    out = variant_parity(good, {"good": good, "wrong": wrong, "missing": missing}, CELL, "brn", 1e-9, 1e-9)
    rows = {r.variant: r for r in out.collect()}
    assert rows["good"].close and rows["good"].unmatched == 0
    assert not rows["wrong"].close and rows["wrong"].max_error == pytest.approx(1.0)
    assert not rows["missing"].close and rows["missing"].unmatched == 2


def test_synthetic_fields(spark):
    grid = fields.index_grid(spark, {"x": 20, "y": 10, "z": 5})
    assert grid.distinct().count() == 1000
    df = fields.synthetic_fields(grid, CELL, seed=3)
    rows = df.collect()
    assert all(0 <= r.P < 1 and r.T == pytest.approx(r.P + 0.1) and r.HHL == pytest.approx(r.P + 0.5) for r in rows)
    ground = {(r.x, r.y): r.P for r in rows if r.z == 0}
    assert all(r.HSURF == pytest.approx(ground[(r.x, r.y)] + 0.6) for r in rows)
    assert 0.45 < sum(r.P for r in rows) / 1000 < 0.55
    again = fields.synthetic_fields(grid.repartition(7), CELL, seed=3)
    assert sorted(again.collect()) == sorted(rows)


def test_constants():
    assert (phys.GRAVITY, phys.R_DRY, phys.R_VAPOUR, phys.CP_DRY, phys.P_SURFACE) == (9.80665, 287.05, 461.51, 1005.0, 1e5)


def test_column_route_gathers_no_cells(spark):
    """Cells travel as rows; only the profile form has arrays, of one segment's levels."""
    cells = spark.range(100).selectExpr(
        "id % 3 AS c", "id div 3 AS z", *[f"double(id + {i}) AS {v}" for i, v in enumerate(physics.BRN_INPUTS)]
    )
    for out in (
        physics.brn(cells, ["c"]), physics.brn_arrow(cells, ["c"]), physics.level_count(cells, ["c"]),
        physics.vertical_cumsum_rev(cells, F.col("p"), ["c"]), physics.last_level_anomaly(cells, F.col("p"), ["c"]),
        structure.isel_reverse(cells, "z", ["c"]), structure.isel(cells, "z", -1, ["c"]),
    ):
        assert "collect_list" not in plan(out)


def test_levels_without_position_are_spread(spark):
    rows = [(1, None, float(i)) for i in range(3000)] + [(1, z, 1.0) for z in range(20)]
    cells = spark.createDataFrame(rows, "c int, z long, a double")
    placed = ranks.cut(cells, ["c"], "z").groupBy("_seg").count().collect()
    assert max(r["count"] for r in placed) < 200 and len(placed) == ranks.SPREAD + 1
    out = physics.vertical_cumsum_rev(cells, F.col("a"), ["c"]).collect()
    assert len(out) == 3020
    assert structure.isel(cells, "z", -1, ["c"]).count() == structure.isel(cells, "z", -2, ["c"]).count() == 1


def test_one_rule_for_equal_positions(spark):
    cells = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (1, 1, 3.0), (1, 2, 4.0), (1, 2, 5.0)], "c int, z long, a double")
    assert [structure.isel(cells, "z", i, ["c"]).count() for i in (-1, -2, -3)] == [2, 2, 1]
