"""Scans, structure, alignment, blocks, ranks and scalar helpers."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.functions import scalars
from gridspark.functions.ieee import ieee_div
from gridspark.operators import align, averages, blocks, physics, ranks, structure
from gridspark.session import materialize, scratch_path
from gridspark.sources import fields
from tests.conftest import SF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_key_filters_reach_the_scan(spark, tmp_path):
    rows = [("T", "layer", 0, 1, 5.0), ("T", "surface", 0, 1, 6.0), ("P", "layer", 0, 1, 7.0)]
    messages = spark.createDataFrame(rows, "short_name string, type_of_level string, level int, c int, value double")
    messages.write.parquet(str(tmp_path / "m"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    stored = fields.scan_files(spark, [str(tmp_path / "m")])
    got = fields.scan_field(stored, "T", ["c", "level"], {"type_of_level": "layer"})
    assert [tuple(r) for r in got.collect()] == [(1, 0, 5.0)]
    text = plan(got)
    assert "EqualTo(short_name,T)" in text and "EqualTo(type_of_level,layer)" in text
    # the filters of one call do not leak into the next
    assert fields.scan_field(stored, "P", ["c"]).count() == 1


def test_merge_fills_gaps(spark):
    a = spark.createDataFrame([(0, 1.0), (1, 2.0)], "x int, a double")
    b = spark.createDataFrame([(1, 3.0), (2, 4.0)], "x int, b double")
    got = {r.x: (r.a, r.b) for r in align.merge_fields([a, b], ["x"]).collect()}
    nan = pytest.approx(float("nan"), nan_ok=True)
    assert got == {0: (1.0, nan), 1: (2.0, 3.0), 2: (nan, 4.0)}


def test_slicing(spark):
    df = spark.createDataFrame([(c, z, c * 10.0 + z) for c in (1, 2) for z in range(c + 2)], "c int, z int, a double")
    def rows(d):
        return sorted((r.c, r.z, r.a) for r in d.collect())

    assert rows(structure.isel(df, "z", -1, ["c"])) == [(1, 2, 12.0), (2, 3, 23.0)]
    assert rows(structure.isel(df, "z", -2, ["c"])) == [(1, 1, 11.0), (2, 2, 22.0)]
    assert rows(structure.isel(df, "z", 0, ["c"])) == [(1, 0, 10.0), (2, 0, 20.0)]
    assert rows(structure.isel_range(df, "z", 1, 3)) == [(1, 0, 11.0), (1, 1, 12.0), (2, 0, 21.0), (2, 1, 22.0)]
    assert rows(structure.isel_reverse(df, "z", ["c"]))[0] == (1, 0, 12.0)
    assert len(rows(structure.drop_last(df, "z", ["c"]))) == 5


def test_adjust_dims(spark):
    df = spark.createDataFrame([(0, 3, 1.0), (1, 3, 2.0)], "x int, t int, a double")
    out = structure.adjust_dims(df, ["x", "t"], ["z", "x"])
    assert out.columns == ["z", "x", "a"] and {r.z for r in out.collect()} == {0}
    with pytest.raises(Exception, match="cannot drop dimension x"):
        structure.adjust_dims(df, ["x", "t"], ["t"]).collect()


def test_transpose_sorts_inside_partitions(spark):
    cells = fields.index_grid(spark, {"x": 3, "y": 3, "z": 3})
    out = structure.transpose(cells, ["z", "y", "x"])
    assert out.columns == ["z", "y", "x"]
    rows = [tuple(r) for r in out.collect()]
    assert rows == sorted(rows)


def test_split_mean_of_odd_size(spark):
    df = spark.createDataFrame([(x, 0, float(x * x)) for x in range(5)], "x int, y int, a double")
    assert averages.avg_dim(df, "a", ["y"]).first().a == pytest.approx(6.0)
    assert averages.avg_split(df, "a", "x", 5, ["y"]).first().a == pytest.approx((0.5 + 29 / 3) / 2)
    holes = df.withColumn("a", F.when(F.col("x") % 2 == 0, F.lit(float("nan"))).otherwise(F.col("a")))
    assert averages.avg_dim(holes, "a", ["y"]).first().a == pytest.approx(5.0)
    assert np.isnan(averages.avg_dim(holes.filter("x % 2 = 0"), "a", ["y"]).first().a)


def test_map_blocks_sees_whole_sorted_chunks(spark):
    cells = fields.index_grid(spark, {"x": 6, "z": 5}).withColumn("a", F.col("x") * 10.0 + F.col("z"))
    sizes = blocks.map_blocks(lambda a: np.full(len(a), len(a)), cells, ["x", "z"], ["a"], {"x": 4}, "n")
    assert {(r.x // 4, r.n) for r in sizes.collect()} == {(0, 20.0), (1, 10.0)}
    steps = blocks.map_blocks(lambda a: np.diff(a, prepend=a[0]), cells, ["x", "z"], ["a"], {"x": 4}, "d")
    assert all(r.d == (1.0 if r.z else (0.0 if r.x in (0, 4) else 6.0)) for r in steps.collect())
    named = blocks.map_blocks_coords(
        lambda c: c["a"] + c.index.get_level_values("z"), cells, ["x", "z"], ["a"], {"x": 4}, "b"
    )
    assert all(r.b == r.x * 10 + 2 * r.z for r in named.collect())
    assert "Exchange" not in plan(blocks.map_cells(lambda a: a, cells, ["x", "z"], ["a"], "b"))


def test_ranks_of_large_groups_with_copies(spark):
    rows = [("hot", i % 50) for i in range(300)] + [("copies", 1)] * 200 + [("small", i) for i in range(7)]
    rows += [(None, i) for i in range(30)] + [("small", None)]
    df = spark.createDataFrame(rows, "k string, o int").repartition(5)
    coarse = [F.floor(F.col("o") / 5).alias("fives")]
    for segments in ((), coarse):
        out = ranks.with_positions(df, ["k"], ["o"], "pos", "n", segments).collect()
        for key, size in {"hot": 300, "copies": 200, "small": 8, None: 30}.items():
            mine = sorted((r.pos, -1 if r.o is None else r.o, r.n) for r in out if r.k == key)
            assert [p for p, _, _ in mine] == list(range(size))
            assert {n for _, _, n in mine} == {size}
            assert [o for _, o, _ in mine] == sorted(o for _, o, _ in mine)


def test_groups_with_null_keys_and_negative_zero(spark, small_groups):
    """A third of all rows in one column, a column without key, and values that grouping must not change."""
    rows = [(c, z, -0.0 if z % 2 else float(z), {"a": z}) for c, n in ((1, 60), (None, 60), (2, 40)) for z in range(n)]
    df = spark.createDataFrame(rows, "c int, z long, a double, m map<string,long>")
    plain = df.drop("m")
    for out, size in (
        (structure.isel_reverse(df, "z", ["c"]), 160), (structure.drop_last(df, "z", ["c"]), 157),
        (structure.isel(df, "z", -2, ["c"]), 3), (physics.level_count(plain, ["c"]), 160),
        (physics.last_level_anomaly(plain, F.col("a"), ["c"]), 160), (physics.vertical_cumsum_rev(plain, F.col("a"), ["c"]), 160),
    ):
        assert out.count() == size
    back = structure.isel_reverse(df, "z", ["c"]).collect()
    assert sum(np.signbit(r.a) for r in back) == sum(np.signbit(r[2]) for r in rows)
    assert {(r.c, r.z, r.m["a"]) for r in back} == {(c, (59 if c != 2 else 39) - z, z) for c, z, _, _ in rows}
    sums = {(r.c, r.z): r.cumsum for r in physics.vertical_cumsum_rev(plain, F.col("a"), ["c"]).collect()}
    assert sums[(None, 59)] == sum(z for z in range(0, 60, 2)) and sums[(2, 0)] == 0


def jobs_while(spark, action):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "jobs while a plan is built")
    try:
        action()
        return len(tracker.getJobIdsForGroup("counted"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_plans_are_built_without_jobs(spark):
    paths = {n: spark.read.parquet(f"{SF}/{n}.parquet") for n in ("lineitem", "orders", "events")}
    assert len(paths) == 3
    cells = spark.range(100).select((F.col("id") % 3).alias("c"), F.floor(F.col("id") / 3).alias("z"), F.col("id").cast("double").alias("a"))
    built = lambda: [
        structure.isel_reverse(cells, "z", ["c"]), physics.level_count(cells, ["c"]),
        physics.vertical_cumsum_rev(cells, F.col("a"), ["c"]), ranks.with_positions(cells, ["c"], ["z"], "p", "n"),
        structure.adjust_dims(cells, ["c", "z"], ["z"]),
    ]
    assert jobs_while(spark, built) == 0


def test_scratch_follows_the_session(spark):
    def session(shared, master):
        context = SimpleNamespace(getCheckpointDir=lambda: None, master=master)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: shared), sparkContext=context)

    assert scratch_path(session("hdfs://shared/", "yarn"), "t").startswith("hdfs://shared/t-")
    for master in ("local[2]", "yarn"):
        with pytest.raises(RuntimeError):
            scratch_path(session(None, master), "t")
    assert materialize(spark.range(3), "t").count() == 3


@pytest.mark.parametrize(
    "text, seconds",
    [("5", 300), ("45", 2700), ("1:30", 90), ("2:03:04", 7384), ("1-2", 93600), ("1-2:30", 95400), ("1-02:30:15", 95415)],
)
def test_slurm_time(spark, text, seconds):
    assert spark.range(1).select(scalars.slurm_seconds(F.lit(text))).first()[0] == seconds


def test_parse_bool(spark):
    df = spark.createDataFrame([("TRUE",), ("False",), (None,)], "s string")
    assert [r[0] for r in df.select(scalars.parse_bool(F.col("s"))).collect()] == [True, False, None]
    with pytest.raises(Exception, match="cannot parse"):
        spark.createDataFrame([("yes",)], "s string").select(scalars.parse_bool(F.col("s"))).collect()


def test_maps(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2", "c": "1"},)], "m map<string,string>")
    assert df.select(scalars.map_inverse(F.col("m"))).first()[0] == {"1": "c", "2": "b"}
    renamed = scalars.map_keys(F.col("m"), scalars.literal_map({"a": "x", "b": "y", "c": "z"}))
    assert df.select(renamed).first()[0] == {"x": "1", "y": "2", "z": "1"}


def test_orders_and_labels(spark):
    df = spark.range(1)
    names = {"x": "lon", "z": "level"}
    long = scalars.expand_order(F.lit("zx"), names)
    assert df.select(long).first()[0] == ["level", "lon"]
    assert df.select(scalars.compact_order(long, names)).first()[0] == "zx"
    label = scalars.variant_label(F.lit("f"), F.array(F.lit("1")), F.create_map(F.lit("k"), F.lit("v")))
    assert df.select(label).first()[0] == "f_1_k=v"
    assert df.select(scalars.flat_list(F.lit(3), 0)).first()[0] == [3]
    assert df.select(scalars.flat_list(F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3))), 2)).first()[0] == [1, 2, 3]


def test_ieee_division(spark):
    pairs = [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (6.0, 3.0), (1.0, -0.0)]
    df = spark.createDataFrame(pairs, "a double, b double")
    got = [r[0] for r in df.select(ieee_div(F.col("a"), F.col("b"))).collect()]
    inf = float("inf")
    assert got == [inf, -inf, pytest.approx(float("nan"), nan_ok=True), 2.0, -inf]


def test_diagnostics_input_from_two_tables(spark, small_groups):
    """Half levels in their own table, one column deeper than one task may hold, no surface height in another."""
    depths = {1: 2, 2: 60, 3: 1}
    layers = [
        (n, "generalVerticalLayer", z, c, 100.0 * c + z + k)
        for c, depth in depths.items()
        for z in range(depth)
        for k, n in enumerate(fields.LAYER_FIELDS)
    ]
    noise = [("P", "surface", 0, c, -1.0) for c in depths]
    half = [("HHL", "generalVertical", z, c, 5000.0 - z) for c, depth in depths.items() for z in range(depth + 1)]
    ground = [("HSURF", "surface", 0, c, 7.0) for c in (1, 2)]
    schema = "short_name string, type_of_level string, level bigint, c bigint, value double"
    first, second = spark.createDataFrame(layers + noise, schema), spark.createDataFrame(half + ground, schema)
    both = fields.diagnostics_input(first, ["c"], second)
    single = fields.diagnostics_input(first.unionByName(second), ["c"])
    for out in (both, single):
        rows = {(r.c, r.z): r for r in out.collect()}
        assert rows.keys() == {(c, z) for c, depth in depths.items() for z in range(depth)}
        for (c, z), r in rows.items():
            assert (r.P, r.V, r.HHL) == (100.0 * c + z, 100.0 * c + z + 4, 5000.0 - z)
            assert r.HSURF == 7.0 if c != 3 else np.isnan(r.HSURF)
