"""Variables of different dimensions, functions on their chunks, layouts as tables, nested records."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import align, blocks, layout, records


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def frames(spark):
    volume = spark.createDataFrame([(x, z, 10.0 * x + z) for x in range(3) for z in range(4) if (x, z) != (1, 2)], "x long, z long, a double")
    other = spark.createDataFrame([(0, 0, 5), (9, 0, 6)], "x long, z long, b long")
    ground = spark.createDataFrame([(0, 0.5), (1, None), (7, 7.5)], "x long, g double")
    levels = spark.createDataFrame([(z, float(z) ** 2) for z in range(2)], "z long, w double")
    return [volume, other, ground, levels, spark.createDataFrame([(3.5,)], "c double")]


def test_dataset_keeps_one_table_for_each_set_of_dimensions(frames):
    merged = align.merge_dataset(frames, ["z", "x", "unused"])
    assert merged.dims == ("z", "x")
    assert {tuple(sorted(k)): v.count() for k, v in merged.tables.items()} == {("x", "z"): 12, ("x",): 3, ("z",): 2, (): 1}
    assert sorted(r.x for r in merged.coordinate("x").collect()) == [0, 1, 2, 7, 9]
    along = {r.x: r.g for r in merged.along("x").collect()}
    assert along[0] == 0.5 and along[7] == 7.5 and all(math.isnan(along[x]) for x in (1, 2, 9))
    cells = {(r.x, r.z): r for r in merged.cells(["a", "g", "w", "c"]).collect()}
    assert len(cells) == 12 and all(r.c == 3.5 for r in cells.values())
    assert cells[0, 1].a == 1 and cells[0, 1].g == 0.5 and cells[0, 1].w == 1
    assert math.isnan(cells[9, 0].a) and math.isnan(cells[2, 3].w) and math.isnan(cells[1, 0].g)
    assert merged.cells(["w", "c"]).columns == ["z", "w", "c"]


def test_dataset_refuses_what_has_no_common_cells(frames):
    merged = align.merge_dataset(frames, ["x", "z"])
    with pytest.raises(ValueError, match="has all"):
        merged.cells(["g", "w"])
    with pytest.raises(ValueError, match="twice"):
        align.merge_dataset([frames[0], frames[0]], ["x", "z"])


def test_map_arrays_sees_axes_types_and_keyword_arguments(spark, frames):
    volume, _, ground, _, _ = frames
    arrays = [blocks.Array(volume, ["x", "z"], "a"), blocks.Array(ground, ["x"], "g")]

    def f(a, g, add, coords):
        assert a.shape == (len(coords["x"]), len(coords["z"])) and g.shape == (len(coords["x"]),)
        return np.nan_to_num(a).astype(int) + add, (a + np.nan_to_num(g)[:, None]).astype(np.float32)

    out = blocks.map_arrays(f, arrays, {"x": 2, "z": 2}, [("n", "int"), ("s", "float")], with_coords=True, add=100)
    assert [k for _, k in out.dtypes] == ["bigint", "bigint", "int", "float"]
    rows = {(r.x, r.z): (r.n, r.s) for r in out.collect()}
    assert len(rows) == 11 and rows[2, 3] == (123, 23.0) and rows[0, 1] == (101, 1.5)


def test_map_arrays_reduces_an_axis(frames):
    volume = frames[0]
    total = blocks.map_arrays(
        lambda a: np.nansum(a, axis=0), [blocks.Array(volume, ["x", "z"], "a")], {"z": 3}, [("s", "double")], ["z"]
    )
    assert {r.z: r.s for r in total.collect()} == {0: 30.0, 1: 33.0, 2: 24.0, 3: 39.0}
    with pytest.raises(ValueError, match="cut"):
        blocks.map_arrays(np.sum, [blocks.Array(volume, ["x", "z"], "a")], {"x": 2}, [("s", "double")], ["z"])
    with pytest.raises(ValueError, match="keyword"):
        blocks.map_arrays(np.sum, [blocks.Array(volume, ["x", "z"], "a"), blocks.Array(frames[3], ["z"], "w")], {"x": 2}, [("s", "double")])
    wrong = blocks.map_arrays(lambda a: a[:1], [blocks.Array(volume, ["x", "z"], "a")], {"x": 2}, [("s", "double")])
    with pytest.raises(Exception, match="expected 1 arrays of shape"):
        wrong.collect()


def test_lower_arrays_are_sent_once_to_each_chunk(frames):
    """The surface joins the table of chunks, not the cells."""
    arrays = [blocks.Array(frames[0], ["x", "z"], "a"), blocks.Array(frames[2], ["x"], "g")]
    seen = blocks.map_arrays(lambda a, g: np.full(a.shape, np.isfinite(g).sum()), arrays, {"x": 2, "z": 1}, [("n", "long")])
    assert {(r.x, r.z): r.n for r in seen.collect()}[0, 3] == 1


def test_layouts_from_a_table(spark):
    layouts = spark.createDataFrame([("a", [30, 50, 20]), ("b", [1] * 40 + [0, 400]), ("c", []), ("d", [10])], "k string, sizes array<int>")
    cells = spark.createDataFrame([(k, p) for k in ("a", "b", "c", "d", "e", None) for p in (0, 9, 10, 29, 30, 39, 40, 79, 80, 99, 100, 439, 440)], "k string, p long")
    out = layout.assign_by_layout(cells, layouts, ["k"], "sizes", "p")
    ends = {"a": [30, 80, 100], "b": [*range(1, 41), 40, 440], "d": [10]}
    for r in out.collect():
        wanted = next((i for i, e in enumerate(ends.get(r.k, [])) if r.p < e), None)
        assert r.chunk_p == wanted, r
    assert out.count() == cells.count()
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)


def test_records_of_any_shape(spark):
    texts = [
        '{"a": 1}', '{"a":{"b":{"c":2.5,"d":[1,{"e":2}]},"z":{}}}', '{"a":{"b":"t"},"e":null}', None, "7", "{}",
        '{"a":' * 9 + "true" + "}" * 9,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, j string").select("k", F.parse_json("j").alias("rec"))
    leaves = records.record_leaves(df, ["k"], "rec").select("k", "path", records.leaf_text(F.col("value")).alias("v"))
    assert {tuple(r) for r in leaves.collect()} == {
        (0, "a", "1"), (1, "a_b_c", "2.5"), (1, "a_b_d", '[1,{"e":2}]'), (2, "a_b", "t"), (2, "e", None), (6, "_".join("a" * 9), "true"),
    }


def test_typed_records_need_no_jobs(spark):
    typed = spark.sql("SELECT 1 AS k, named_struct('m', map('x', named_struct('u', 2, 'l', array(1, 2)), 'y', null), 'n', cast(null AS int)) AS rec")
    leaves = records.record_leaves(typed, ["k"], "rec").select("path", records.leaf_text(F.col("value")).alias("v"))
    assert {tuple(r) for r in leaves.collect()} == {("m_x_u", "2"), ("m_x_l", "[1,2]"), ("m_y", None), ("n", None)}
    assert records.record_leaves(typed.where("k = 2"), ["k"], "rec").count() == 0


def test_flat_items_of_ragged_lists(spark):
    texts = {0: "[[1, [2]], 3, [], [[[[4]]]]]", 1: "7", 2: "[]", 3: '[{"a": [1]}, null]', 4: None, 5: "null"}
    df = spark.createDataFrame(list(texts.items()), "k int, text string").select("k", F.parse_json("text").alias("v"))
    found = records.flat_items(df, ["k"], "v").select("k", "place", F.to_json("item").alias("item")).collect()
    items = {k: [r["item"] for r in sorted((r for r in found if r.k == k), key=lambda r: r.place)] for k in texts}
    assert items == {0: ["1", "2", "3", "4"], 1: ["7"], 2: [], 3: ['{"a":[1]}', "null"], 4: [], 5: ["null"]}
    arrays = spark.createDataFrame([(1, [[1, 2], [3]]), (2, [[]])], "k int, v array<array<int>>")
    assert sorted((r.k, r.place) for r in records.flat_items(arrays, ["k"], "v").collect()) == [(1, [0, 0]), (1, [0, 1]), (1, [1, 0])]
    assert records.flat_items(df.limit(0), ["k"], "v").collect() == []
    scalar = spark.createDataFrame([(1, 5)], "k int, v int")
    assert [r.place for r in records.flat_items(scalar, ["k"], "v").collect()] == [[]]
