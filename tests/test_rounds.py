"""Work in rounds of whole groups: every row once, right results, and nothing left on disk but what is needed."""

from __future__ import annotations

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gridspark.operators import physics, rounds
from gridspark.operators.parity import variant_parity, whole_parity
from gridspark.plans import field_queries, fixtures
from gridspark.session import scratch_path
from tests.test_physics import CELL, KEYS, brute_brn, by_cell, random_columns

ORDERS = "o_orderkey bigint, o_totalprice double"
LINES = (
    "l_orderkey bigint, l_linenumber bigint, l_partkey bigint, l_suppkey bigint, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double"
)


@pytest.fixture
def many_rounds(monkeypatch):
    """Tables of more than ten rows take several rounds."""
    monkeypatch.setattr(rounds, "ROUND_ROWS", 10)
    monkeypatch.setattr(rounds, "MOST_ROUNDS", 3)
    return 3


@pytest.fixture
def tables(spark, tmp_path):
    """Forty orders of up to seven lines, one of them with twice the same lines; lines without a key or an order."""
    lines = [
        (None if o == 98 else o, k, (o * 7 + k) % 50, k, 1.0 + (o + k) % 40, 900.0 + o * k, 0.01 * (k % 5), 0.01 * (o % 4))
        for o in [*range(40), 7, 98, 99]
        for k in range(1, 2 + o % 7)
    ]
    spark.createDataFrame(lines, LINES).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(o, 1000.0 + o) for o in range(40)], ORDERS).write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def folders(spark, tag):
    base = Path(scratch_path(spark, tag).removeprefix("file:")).parent
    return {str(f) for f in base.glob(f"{tag}-*")}


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    names = set()
    while found.hasNext():
        names.add(found.next().getName())
    return {n for n in names if n.startswith("shuffle_")}


def left_over(spark, before):
    """Shuffle files that are still there; Spark removes them in the background."""
    for _ in range(40):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.25)
    return left


def most_rows_stored(monkeypatch, module):
    """Rows of each table that ``module`` stores."""
    sizes, store = [], module.store

    def spy(df, path, *mode):
        sizes.append(df.count())
        store(df, path, *mode)

    monkeypatch.setattr(module, "store", spy)
    return sizes


def test_rounds_hold_whole_groups_once(spark, many_rounds):
    rows = [(None if c == 3 else c, z) for c in range(30) for z in range(c % 4 + 1)]
    df = spark.createDataFrame([*rows, rows[0]], "c int, z int")
    parts = [[tuple(r) for r in p.collect()] for p in rounds.rounds(df, ["c"])]
    assert len(parts) == many_rounds and sum(map(bool, parts)) > 1
    assert sorted(map(str, sum(parts, []))) == sorted(map(str, [*rows, rows[0]]))
    assert sum(len({c for c, _ in p}) for p in parts) == 30
    assert [p.count() for p in rounds.rounds(df.limit(0), ["c"])] == [0]
    folded = df.select(F.expr("string(z) COLLATE UTF8_LCASE AS s"))
    assert [p.count() for p in rounds.rounds(folded, ["s"])] == [p.count() for p in rounds.rounds(df, [])] == [df.count()]


def test_grid_in_rounds_is_the_whole_grid(spark, many_rounds, tables, monkeypatch):
    whole = sorted(fixtures.derived_cells(spark, tables).collect())
    sizes = most_rows_stored(monkeypatch, fixtures)
    assert sorted(fixtures.grid_cells(spark, tables).collect()) == whole
    assert len(sizes) == many_rounds and sum(sizes) == len(whole) and max(sizes) < 0.6 * len(whole)


def test_grid_leaves_no_shuffle_files(spark, tables):
    before = shuffle_files(spark)
    fixtures.grid_cells(spark, tables)
    assert not left_over(spark, before)


def test_grid_is_used_only_when_all_rounds_are_stored(spark, many_rounds, tables, monkeypatch):
    whole, store, calls = fixtures.derived_cells(spark, tables).count(), fixtures.store, []

    def third_fails(*args):
        calls.append(args)
        if len(calls) == 3:
            raise RuntimeError("lost")
        store(*args)

    monkeypatch.setattr(fixtures, "store", third_fails)
    with pytest.raises(RuntimeError):
        fixtures.grid_cells(spark, tables)
    assert fixtures.grid_cells(spark, tables).count() == whole


@pytest.mark.parametrize("n", [1, 3])
def test_repeated_brn_in_rounds(spark, many_rounds, monkeypatch, n):
    cells = random_columns(spark, [1, 4, 9, 2, 13, 5, 7, 3, 30, 6])
    sizes = most_rows_stored(monkeypatch, physics)
    out = physics.repeated_brn(cells, KEYS, n)
    assert len(sizes) == many_rounds * n and sum(sizes) == 80 * n and max(sizes) < 60
    got = by_cell(out, "brn")
    expected = brute_brn(cells.collect())
    assert got.keys() == expected.keys() and out.count() == 80 and out.columns == [*CELL, "brn"]
    for k, v in expected.items():
        assert got[k] == pytest.approx(v if n == 1 else float("nan"), rel=1e-9, abs=1e-12, nan_ok=True)


def test_repeated_brn_keeps_the_results_alone(spark):
    """Neither shuffle files nor the states between two rounds of the formula stay."""
    cells = random_columns(spark, [1, 4, 9])
    before, states = shuffle_files(spark), folders(spark, "repeat")
    out = physics.repeated_brn(cells, KEYS, 3)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert not left_over(spark, before)
    assert folders(spark, "repeat") == states


def test_variant_parity_in_rounds(spark, many_rounds, tables, monkeypatch):
    """Every form is run on parts of the grid, which add up to it; shuffle files go with each part."""
    whole = fixtures.grid_cells(spark, tables).count()
    parts, form = [], physics.BRN_VARIANTS["brn_arrow"]
    monkeypatch.setitem(physics.BRN_VARIANTS, "brn_arrow", lambda cells, keys: parts.append(cells) or form(cells, keys))
    before = shuffle_files(spark)
    out = field_queries.variant_parity(spark, tables)
    assert not left_over(spark, before)
    seen = [p.count() for p in parts]
    assert len(seen) == many_rounds and sum(seen) == whole and max(seen) < 0.6 * whole
    rows = {r.variant: r for r in out.collect()}
    assert rows.keys() == {"brn_windows", "brn_arrow", "brn_segmented", "thetav_arrow"}
    assert {r.cells for r in rows.values()} == {whole}


def test_whole_parity_keeps_what_any_part_found(spark):
    cells = random_columns(spark, [3, 4])
    good = physics.brn_windows(cells, KEYS)
    wrong = good.withColumn("brn", F.when(F.col("x") == 1, F.col("brn") + F.col("z")).otherwise(F.col("brn")))
    missing = good.filter("x > 0 or z > 0")

    def report(*conditions):
        forms = {"good": good, "wrong": wrong, "missing": missing}
        parts = [
            variant_parity(good.filter(c), {n: f.filter(c) for n, f in forms.items()}, CELL, "brn", 1e-9, 1e-9)
            for c in conditions
        ]
        return parts[0] if len(parts) == 1 else whole_parity(parts[0].unionByName(parts[1]))

    assert sorted(report("x < 1", "x >= 1").collect()) == sorted(report("true").collect())
