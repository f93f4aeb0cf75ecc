"""Chunk arithmetic against a plain restatement, and physical chunking."""

from __future__ import annotations

import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridspark.functions import chunks as ch
from gridspark.operators import layout
from gridspark.sources import fields


def expand(spec, size):
    """Chunk sizes by walking along the dimension."""
    if not isinstance(spec, int):
        return list(spec)
    if spec == -1:
        return [size]
    out, at = [], 0
    while at < size:
        out.append(min(spec, size - at))
        at += out[-1]
    return out


def ends(sizes):
    return set(itertools.accumulate(sizes))


def merges(a, b):
    """Chunks of layout a can be merged into those of layout b."""
    if b == -1:
        return True
    if a == -1:
        return False
    if isinstance(a, int) and isinstance(b, int):
        return b % a == 0
    la = expand(a, sum(b) if not isinstance(b, int) else 0)
    lb = expand(b, sum(a) if not isinstance(a, int) else 0)
    return sum(la) == sum(lb) and ends(lb) <= ends(la)


def text(spec):
    return str(spec) if isinstance(spec, int) else ",".join(map(str, spec))


specs = st.one_of(st.just(-1), st.integers(1, 12), st.lists(st.integers(1, 6), min_size=2, max_size=6))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(specs, specs), min_size=20, max_size=40))
def test_no_split_text(spark, pairs):
    rows = [(i, text(a), text(b)) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    got = df.select("i", ch.no_split_text("a", "b").alias("ok")).collect()
    for r in got:
        assert r.ok == merges(*pairs[r.i]), pairs[r.i]


def test_no_split_open_specs(spark):
    df = spark.createDataFrame([(None, "3"), ("3", None), (None, None)], "a string, b string")
    assert all(r[0] for r in df.select(ch.no_split_text("a", "b")).collect())


def test_unequal_totals_do_not_fit(spark):
    df = spark.createDataFrame([("2,2", "2,2,2"), ("2,2,2", "2,2"), ("4,2", "2,4")], "a string, b string")
    assert not any(r[0] for r in df.select(ch.no_split_text("a", "b")).collect())


def test_sizes_and_equality(spark):
    rows = [(s1, s2, d) for s1 in (-1, 1, 3, 7, 20) for s2 in (-1, 1, 3, 7, 20) for d in (1, 7, 20)]
    df = spark.createDataFrame(rows, "s1 bigint, s2 bigint, d bigint")
    got = df.select(
        "*",
        ch.chunk_sizes(F.col("s1"), F.col("d")).alias("sizes"),
        ch.specs_equal(F.col("s1"), F.col("s2"), F.col("d")).alias("same"),
        ch.chunk_count(F.col("s1"), F.col("d")).alias("n"),
    )
    for r in got.collect():
        assert r.sizes == expand(r.s1, r.d) and r.n == len(r.sizes)
        assert r.same == (expand(r.s1, r.d) == expand(r.s2, r.d))


def test_equality_of_lists(spark):
    rows = [("5", "5,5,2", 12), ("5,5,2", "5", 12), ("5,7", "7,5", 12), ("12", "-1", 12), ("6,6", "6", 12),
            ("auto", "5,7", 12), (None, "3", 12), ("4", "6", 12)]
    df = spark.createDataFrame(rows, "a string, b string, d bigint")
    got = [r[0] for r in df.select(ch.texts_equal(F.col("a"), F.col("b"), F.col("d"))).collect()]
    assert got == [True, True, False, True, True, True, True, False]


def test_explode_chunks_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(layout, "NUMBERS_PER_BLOCK", 3)
    df = spark.createDataFrame([(1, 2, 15), (2, -1, 15), (3, None, 15), (4, 1, 7)], "id int, s bigint, d bigint")
    rows = layout.explode_chunks(df, ["id"], F.col("s"), F.col("d")).collect()
    for i, s, d in ((1, 2, 15), (2, -1, 15), (4, 1, 7)):
        mine = sorted((r.chunk_idx, r.start, r.size) for r in rows if r.id == i)
        starts = [0, *itertools.accumulate(expand(s, d))][:-1]
        assert mine == [(k, a, b) for k, (a, b) in enumerate(zip(starts, expand(s, d)))]
    assert not [r for r in rows if r.id == 3]


def test_auto_and_open(spark):
    df = spark.createDataFrame([({"x": "auto", "y": None, "z": "5"},)], "chunks map<string,string>")
    assert df.select(ch.simplify_map(F.col("chunks"))).first()[0] == {"x": -1, "z": 5}
    assert df.select(ch.simplify_map(F.col("chunks"), auto=64)).first()[0] == {"x": 64, "z": 5}


@pytest.mark.parametrize("spec", [-1, 1, 4, [3, 4, 5], [12]])
def test_chunk_of(spark, spec):
    got = {r.id: r.c for r in spark.range(12).select("id", ch.chunk_of(F.col("id"), spec).alias("c")).collect()}
    owner = [k for k, n in enumerate(expand(spec, 12)) for _ in range(n)]
    assert [got[i] for i in range(12)] == owner


def test_rechunk_is_skipped_when_equal(spark):
    cells = fields.index_grid(spark, {"x": 6, "y": 4})
    same = layout.rechunk(cells, {"x": 2}, current={"x": 2})
    other = layout.rechunk(cells, {"x": 2}, current={"x": 3})
    plans = [d._jdf.queryExecution().executedPlan().toString() for d in (same, other)]
    assert "Exchange" not in plans[0] and "Exchange" in plans[1]


def test_chunk_predicate_prunes_directories(spark, tmp_path):
    cells = layout.with_chunks(fields.index_grid(spark, {"x": 8, "y": 4}), {"x": 2})
    fields.write_chunked(cells, str(tmp_path / "c"), ["chunk_x"])
    read = fields.read_cells(spark, str(tmp_path / "c")).filter("chunk_x = 3")
    assert sorted({r.x for r in read.collect()}) == [6, 7]
    assert "PartitionFilters: [isnotnull(chunk_x" in read._jdf.queryExecution().executedPlan().toString()


def test_same_chunks_by_size():
    same = layout.same_chunks
    assert same(None, 5) and same("auto", [1, 2]) and same(5, 5) and not same(5, 4) and not same(-1, 10)
    assert same(-1, 10, 10) and same(12, -1, 10) and same(4, [4, 4, 2], 10) and not same(4, [4, 6], 10) and same(3, -1, 0)


def test_dimension_of_size_zero_has_no_chunks(spark):
    df = spark.createDataFrame([(1, 0, 5), (2, 0, -1), (3, 7, 5)], "k int, n bigint, s bigint")
    out = layout.explode_chunks(df, ["k"], F.col("s"), F.col("n")).collect()
    assert sorted((r.k, r.chunk_idx, r.start, r.size) for r in out) == [(3, 0, 0, 5), (3, 1, 5, 2)]


def test_chunks_of_far_positions(spark):
    far = (1 << 53) + 3
    df = spark.createDataFrame([(far,), (-1,), (7,)], "x bigint")
    got = [r[0] for r in df.select(ch.chunk_of(F.col("x"), 2)).collect()]
    assert got == [far // 2, -1, 3]
