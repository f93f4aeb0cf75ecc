"""Files that overlap or lack variables, fields aligned by label, tables placed by chunk."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import align, layout
from gridspark.session import scratch_path
from gridspark.sources import fields

NAN = float("nan")


def plan(df):
    df.collect()  # the adaptive plan is final afterwards
    return df._jdf.queryExecution().executedPlan().toString()


# ---------------------------------------------------------------- files


@pytest.fixture(scope="module")
def files(spark):
    base = scratch_path(spark, "files")
    spark.createDataFrame([(0, 1.0, "a"), (1, NAN, None), (2, None, "c")], "x long, t double, s string").write.parquet(f"{base}/1")
    spark.createDataFrame([(1, 5.0, 7), (2, NAN, 8), (3, 6.0, None)], "x long, t double, n int").write.parquet(f"{base}/2")
    spark.createDataFrame([(0, 2.0), (None, 3.0), (None, 3.0)], "x long, t double").write.parquet(f"{base}/3")
    return base


def test_files_that_overlap_and_lack_variables(spark, files):
    out = fields.scan_aligned(spark, [f"{files}/1", f"{files}/2"], ["x"])
    assert dict(out.dtypes) == {"x": "bigint", "t": "double", "s": "string", "n": "int"}
    rows = {r.x: r for r in out.collect()}
    assert [rows[x].t for x in range(4)] == [1.0, 5.0, pytest.approx(NAN, nan_ok=True), 6.0]
    assert [rows[x].s for x in range(4)] == ["a", None, "c", None] and [rows[x].n for x in range(4)] == [None, 7, 8, None]


def test_conflicting_files_are_an_error_of_the_query(spark, files):
    out = fields.scan_aligned(spark, [f"{files}/1", f"{files}/2", f"{files}/3"], ["x"])
    with pytest.raises(Exception, match=r"t differs between .*/1/.* and .*/3/"):
        out.collect()


@pytest.mark.parametrize(("rule", "value"), [("first", 1.0), ("last", 2.0)])
def test_conflicts_settled_by_file(spark, files, rule, value):
    rows = {r.x: r.t for r in fields.scan_aligned(spark, [f"{files}/1", f"{files}/2", f"{files}/3"], ["x"], rule).collect()}
    assert rows[0] == value and rows[None] == 3.0 and rows[1] == 5.0 and math.isnan(rows[2])
    with pytest.raises(ValueError, match="rule"):
        fields.scan_aligned(spark, [f"{files}/1"], ["x"], "any")


# ---------------------------------------------------------------- labels


def test_alignment_by_label(spark):
    a = spark.createDataFrame([(x, z, 0.5 * x, float(10 * x + z)) for x in range(5) for z in range(2)], "x long, z long, lon double, a double")
    shifted = [(x, z, 0.5 * (x + 2), float(x)) for x in range(5) for z in range(3)] + [(9, 0, None, 1.0)]
    b = spark.createDataFrame(shifted, "x long, z long, lon double, b double")
    out = align.align_labels(a, b, ["x", "z"], {"x": "lon"})
    assert out.columns == ["x", "z", "lon", "a", "b"]
    rows = {(r.x, r.z): (r.lon, r.a, r.b) for r in out.collect()}
    # labels 1.0, 1.5 and 2.0 are shared; they get positions 0, 1 and 2
    assert rows == {(i, z): (1.0 + 0.5 * i, 10.0 * (i + 2) + z, float(i)) for i in range(3) for z in range(2)}
    by_position = align.align_fields(a.drop("lon"), b.drop("lon"), ["x", "z"])
    assert by_position.count() == 10 and by_position.where("b <> x").count() == 0


@pytest.mark.parametrize("segment", [2, 1024])
def test_alignment_by_several_labels_in_segments(spark, monkeypatch, segment):
    monkeypatch.setattr(align.ranks, "SEGMENT", segment)
    a = spark.createDataFrame([(x, z, f"c{9 - x}", 100 * z, x + z) for x in range(6) for z in range(5)], "x long, z long, name string, h int, a int")
    b = a.where("x % 2 = 0 and z <> 1").select("x", "z", "name", "h", (F.col("a") * 2).alias("b"))
    rows = align.align_labels(a, b, ["x", "z"], {"x": "name", "z": "h"}).collect()
    assert {(r.x, r.z) for r in rows} == {(x, z) for x in range(3) for z in range(4)}
    assert all(r.b == 2 * r.a and r.name == f"c{9 - 2 * r.x}" for r in rows)


def test_labels_at_several_positions_are_an_error(spark):
    a = spark.createDataFrame([(0, 1.0, 1), (1, 1.0, 2)], "x long, lon double, a int")
    b = spark.createDataFrame([(0, 1.0, 1)], "x long, lon double, b int")
    for first, second in ((a, b), (b.withColumnRenamed("b", "c"), a)):
        with pytest.raises(Exception, match="several positions of x are labelled 1.0"):
            align.align_labels(first, second, ["x"], {"x": "lon"}).collect()
    with pytest.raises(ValueError, match="twice"):
        align.align_labels(a, a, ["x"], {"x": "lon"})
    assert align.align_labels(a.limit(0), b, ["x"], {"x": "lon"}).collect() == []


# ---------------------------------------------------------------- placed chunks


def test_placed_chunks_join_and_aggregate_without_an_exchange(spark):
    session = fields.placed_session(spark)
    cells = spark.createDataFrame([(x, z, float(x * z), float(x - z)) for x in range(200) for z in range(3)], "x long, z long, t double, u double")
    chunked = layout.with_chunks(cells, {"x": 10})
    names = []
    for v in ("t", "u"):
        path = scratch_path(spark, f"placed{v}")
        names.append(path.rsplit("/", 1)[1].replace("-", "_"))
        fields.write_placed(chunked.select("chunk_x", "x", "z", v), names[-1], path, ["chunk_x"], ["x", "z"], 4)
    # no broadcast, so that the join would have to move both sides
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    t, u = map(session.table, names)
    joined = t.join(u, ["chunk_x", "x", "z"])
    means = joined.groupBy("chunk_x", "z").agg(F.avg(F.col("t") * F.col("u")).alias("m"), F.count("*").alias("n"))
    assert "Exchange" not in plan(means) and "Exchange" not in plan(t.groupBy("chunk_x").agg(F.max("t")))
    got = {(r.chunk_x, r.z): (r.m, r.n) for r in means.collect()}
    assert len(got) == 60
    for (c, z), (m, n) in got.items():
        assert n == 10 and m == pytest.approx(np.mean([x * z * (x - z) for x in range(10 * c, 10 * c + 10)]))
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
