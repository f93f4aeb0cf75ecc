"""Result cubes, reductions and scaling fits on small known inputs."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import cube, records, scaling
from gridspark.plans import sweep as sw
from gridspark.sources import fields
from gridspark.sources import results as store

NAN = float("nan")


def approx_nan(v):
    return pytest.approx(v, nan_ok=True)


def test_reductions(spark):
    rows = [("a", 0, 9.0), ("a", 1, 1.0), ("a", 2, NAN), ("a", 3, 3.0), ("b", 0, 1.0), ("b", 1, NAN)]
    df = spark.createDataFrame(rows, "impl string, iteration int, rt double")
    def run(reduction, warmup=True):
        out = cube.reduce_iterations(df, ["impl"], ["rt"], warmup, reduction)
        return {r.impl: r.rt for r in out.collect()}

    assert run("nanmean") == {"a": 2.0, "b": approx_nan(NAN)}
    assert run("nanmin") == {"a": 1.0, "b": approx_nan(NAN)}
    assert run("nanmax", warmup=False) == {"a": 9.0, "b": 1.0}
    assert run("min") == {"a": approx_nan(NAN), "b": approx_nan(NAN)}
    assert run("mean", warmup=False) == {"a": approx_nan(NAN), "b": approx_nan(NAN)}


def test_cube_is_dense_and_last_row_wins(spark):
    rows = [(0, "a", 1, 5.0), (1, "a", 1, 6.0), (2, "b", 2, 7.0)]
    df = spark.createDataFrame(rows, "seq int, impl string, workers int, rt double")
    got = {(r.impl, r.workers): r.rt for r in cube.result_cube(df, ["impl", "workers"], ["rt"], "seq").collect()}
    assert got == {("a", 1): 6.0, ("a", 2): approx_nan(NAN), ("b", 1): approx_nan(NAN), ("b", 2): 7.0}


def test_cores_dimension(spark):
    rows = [("a", 1, 4, 8.0), ("a", 2, 2, 7.0), ("a", 4, 1, 9.0), ("a", 1, 1, NAN), ("a", 2, 1, 3.0), ("a", 1, 2, NAN)]
    df = spark.createDataFrame(rows, "impl string, workers int, cpw int, rt double")
    dims = ["impl", "workers", "cpw"]
    out = cube.create_cores_dimension(df, dims, ["rt"], ["workers", "cpw"])
    got = {r.cores: r.rt for r in out.collect()}
    assert got == {4: 7.0, 1: approx_nan(NAN), 2: approx_nan(NAN)}
    ignoring = cube.create_cores_dimension(df, dims, ["rt"], ["workers", "cpw"], reduction="nanmin")
    assert {r.cores: r.rt for r in ignoring.collect()}[2] == 3.0


def test_labels(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "impl string, rt double")
    out = cube.rename_labels(df, {"impl": ["x", "y", "z"]})
    assert {r.impl: r.rt for r in out.collect()} == {"x": 1.0, "y": 2.0, "z": 3.0}
    with pytest.raises(ValueError):
        cube.rename_labels(df, {"impl": ["x", "y"]})
    assert [r.impl for r in cube.remove_labels(df, "impl", ["a", "c"]).collect()] == ["b"]
    with pytest.raises(KeyError):
        cube.remove_labels(df, "impl", ["a", "nowhere"])


def test_combined_runtimes_are_marked(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 3.0), ("b", 1.0, NAN, 3.0)], "impl string, p double, q double, r double")
    out = cube.combine_runtimes(df, "sum", ["p", "q"])
    assert {r.impl: r["sum"] for r in out.collect()} == {"a": 3.0, "b": approx_nan(NAN)}
    assert cube.plain_parts(out, ["p", "q", "r", "sum"]) == ["p", "q", "r"]
    shares = cube.runtime_shares(out, ["impl"], ["p", "q", "r", "sum"]).collect()
    assert {r.impl for r in shares} == {"a"}
    assert [(r.rt_type, r.share, r.offset) for r in sorted(shares, key=lambda r: r.pos)] == [
        ("p", pytest.approx(1 / 6), 0.0),
        ("q", pytest.approx(2 / 6), pytest.approx(1 / 6)),
        ("r", pytest.approx(3 / 6), pytest.approx(3 / 6)),
    ]
    with pytest.raises(ValueError):
        cube.combine_runtimes(df, "nothing", [])


def test_complete_series(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, NAN)], "impl string, p double, q double")
    assert {r.rt_type for r in cube.complete_series(df, ["impl"], ["p", "q"]).collect()} == {"p"}


def amdahl_rows(fractions):
    return [(n, c, 100.0 * (f + (1 - f) / c)) for n, f in fractions.items() for c in (1, 2, 4, 8, 16)]


def test_serial_fraction_recovers_exact_data(spark):
    fractions = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 1.0}
    df = spark.createDataFrame(amdahl_rows(fractions), "impl string, cores int, rt double")
    got = {r.impl: r.serial for r in scaling.serial_fraction(df, ["impl"], "cores", "rt").collect()}
    assert got == pytest.approx(fractions, abs=1e-12)
    spd = {(r.impl, r.cores): r.speedup for r in cube.speedup(df, ["impl"], "cores", "rt").collect()}
    assert spd[("a", 16)] == pytest.approx(16.0) and spd[("d", 16)] == pytest.approx(1.0)
    curve = [r for r in scaling.scaling_curve(df, ["impl"], "cores", "rt").collect() if r.impl == "c"]
    assert len(curve) == 100
    assert {min(r.x for r in curve), max(r.x for r in curve)} == {1.0, 16.0}
    for r in curve:
        assert r.speedup == pytest.approx(1 / (0.5 + 0.5 / r.x))


def test_serial_fraction_with_given_base(spark):
    df = spark.createDataFrame([r for r in amdahl_rows({"a": 0.2}) if r[1] > 2], "impl string, cores int, rt double")
    base = spark.createDataFrame([("a", 1, 100.0)], "impl string, base_cores int, base_runtime double")
    assert scaling.serial_fraction(df, ["impl"], "cores", "rt", base).first().serial == pytest.approx(0.2)
    assert cube.speedup(df, ["impl"], "cores", "rt", base.drop("base_cores")).first().speedup > 2


def test_regressions(spark):
    rng = np.random.default_rng(0)
    x, y = rng.uniform(1, 9, 50), rng.uniform(1, 9, 50)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    beta, alpha = np.polyfit(x, y, 1)
    got = scaling.lin_reg(df, [], "x", "y").first()
    assert (got.alpha, got.beta) == (pytest.approx(alpha), pytest.approx(beta))
    power = spark.createDataFrame([("s", float(c), 3.0 * c**0.7) for c in (1, 2, 4, 8)], "s string, c double, v double")
    fit = scaling.power_law_fit(power, ["s"], "c", "v").first()
    assert (fit.alpha, fit.beta) == (pytest.approx(3.0), pytest.approx(0.7))
    error = scaling.scaling_fit_error(power, ["s"], "c", "v").first()
    assert (error.rate, error.factor, error.error) == (pytest.approx(-0.7), pytest.approx(math.log(3)), pytest.approx(0, abs=1e-12))


def test_relative_runtime(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.0), ("b", 1, 6.0), ("b", 3, 1.0)], "impl string, c int, rt double")
    got = {(r.impl, r.c): r.relative for r in cube.relative_runtime(df, "impl", "c", "rt", "a").collect()}
    assert got == {("a", 1): 1.0, ("a", 2): 1.0, ("b", 1): 3.0, ("b", 3): None}


def test_config_grid(spark):
    got = {tuple(r) for r in cube.config_grid(spark, a=[1, 2], b="x", c=[True, False]).collect()}
    assert got == {(a, "x", c) for a in (1, 2) for c in (True, False)}


def test_result_tables_replace_one_experiment(spark, tmp_path):
    path = str(tmp_path / "r")
    one = spark.createDataFrame([("a", 1.0)], "impl string, rt double")
    store.save_results(one, "first", path)
    store.save_results(one.withColumn("rt", F.lit(2.0)), "second", path)
    store.save_results(one.withColumn("rt", F.lit(3.0)), "second", path)
    assert [tuple(r) for r in store.load_results(spark, "first", path).collect()] == [("a", 1.0)]
    assert [tuple(r) for r in store.load_results(spark, "second", path).collect()] == [("a", 3.0)]


def test_flatten_record(spark):
    df = spark.range(1).select(
        F.struct(F.lit(1).alias("n"), F.struct(F.lit(True).alias("b"), F.lit("t").alias("s")).alias("in")).alias("r")
    )
    assert records.flatten_record(df).first().asDict() == {"r_n": 1, "r_in_b": "True", "r_in_s": "t"}


def test_attribute_comparison(spark):
    rows = [("a", 1, "a", 1), ("a", None, "a", 2), ("a", 1, "b", 1), ("a", 1, "a", None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "p string, q int, r string, s int")
    x, y = {"p": F.col("p"), "q": F.col("q")}, {"p": F.col("r"), "q": F.col("s")}
    got = df.select(records.has_attributes(x, y).alias("h"), records.equals_not_none(x, y).alias("e")).collect()
    assert [r.h for r in got] == [True, True, False, False, True]
    assert [r.e for r in got] == [True, True, False, True, True]
    lacking = df.select(records.has_attributes(x, {"p": F.col("r")})).collect()
    assert [r[0] for r in lacking] == [False, True, False, False, True]


def test_overlay(spark):
    def merge(base, upd):
        """Deep merge of nested dictionaries."""
        out = dict(base)
        for k, v in upd.items():
            both = isinstance(v, dict) and isinstance(base.get(k), dict)
            out[k] = merge(base[k], v) if both else v
        return out

    def leaves(tree, prefix=""):
        for k, v in tree.items():
            if isinstance(v, dict):
                yield from leaves(v, f"{prefix}{k}.")
            else:
                yield f"{prefix}{k}", v

    cases = [
        ({"a": {"b": "1", "c": {"d": "2"}}, "e": "3"}, {"a": {"c": "9"}, "f": {"g": "4"}}),
        ({"a": "1", "b": {"c": "2"}}, {"a": {"x": "5"}, "b": {"c": "7", "d": "8"}}),
        ({"a": "1"}, {}),
        ({"ab": {"c": "1"}, "a": {"c": "2"}}, {"a": "3"}),
    ]
    base = [(i, p, v) for i, (b, _) in enumerate(cases) for p, v in leaves(b)]
    upd = [(i, p, v) for i, (_, u) in enumerate(cases) for p, v in leaves(u)]
    schema = "id int, path string, value string"
    out = records.overlay(spark.createDataFrame(base, schema), spark.createDataFrame(upd, schema), "id").collect()
    for i, (b, u) in enumerate(cases):
        assert sorted((r.path, r.value) for r in out if r.id == i) == sorted(leaves(merge(b, u)))


def test_sweep(spark, tmp_path):
    cells = fields.index_grid(spark, {"x": 50, "y": 4}).withColumn("a", F.col("x") * 1.0)
    fields.write_cells(cells, str(tmp_path / "c"))
    operators = {"same": lambda df: df, "mean": lambda df: df.groupBy("y").agg(F.avg("a").alias("a"))}
    raw = sw.measure_runtimes(spark, operators, {"flat": lambda: fields.read_cells(spark, str(tmp_path / "c"))}, 2)
    rows = raw.collect()
    assert len(rows) == 6 and {r.iteration for r in rows} == {0, 1, 2}
    for r in rows:
        stages = [r[p] for p in sw.PARTS[1:]]
        assert all(s >= 0 for s in stages) and r.full_rt == pytest.approx(sum(stages))
    reduced = cube.reduce_iterations(raw, ["impl", "layout"], sw.PARTS)
    assert reduced.count() == 2


def test_laws_follow_ieee(spark):
    from gridspark.functions.scalars import amdahl_speedup
    from gridspark.operators import scaling

    df = spark.createDataFrame([(-1.0, 2.0), (0.5, 0.0), (0.0, 4.0)], "f double, c double")
    assert [r[0] for r in df.select(amdahl_speedup(F.col("f"), F.col("c"))).collect()] == [float("inf"), 0.0, 4.0]
    one = spark.createDataFrame([("a", 1.0, 2.0)], "s string, x double, y double")
    assert all(r != r for r in scaling.lin_reg(one, ["s"], "x", "y").select("alpha", "beta").first())
    zero = spark.createDataFrame([("a", 0, 2.0), ("a", 1, 1.0)], "s string, c bigint, r double")
    assert scaling.serial_fraction(zero, ["s"], "c", "r").count() == 1


def test_marks_labels_and_references(spark):
    df = spark.createDataFrame([("a", 1, 1, 2.0), ("a", 2, 1, 1.0), ("b", 1, 1, 4.0)], "impl string, workers int, cores int, rt double")
    marked = cube.combine_runtimes(df, "total", ["rt"])
    reduced = cube.create_cores_dimension(marked, ["impl", "workers", "cores"], ["rt", "total"], ["workers", "cores"], "c")
    assert cube.plain_parts(reduced, ["rt", "total"]) == ["rt"]
    assert cube.plain_parts(cube.marginal(marked, "impl", "workers", ["rt", "total"]), ["rt", "total"]) == ["rt"]
    relative = {(r.impl, r.workers): r.relative for r in cube.relative_runtime(df, "impl", "workers", "rt").collect()}
    assert relative == {("a", 1): 1.0, ("a", 2): 1.0, ("b", 1): 2.0}
    alone = cube.relative_runtime(df.filter("impl = 'b'"), "impl", "workers", "rt").first()
    assert alone.relative == 4.0
    renamed = cube.rename_labels(df, {"workers": {1: "one", 2: 7}})
    assert {r.workers for r in renamed.collect()} == {"one", "7"}


def test_labels_keep_their_types(spark, tmp_path):
    texts = ["3", '"3"', "10", "2.5", '"a"', "true", '"true"', "-1", "null", "3"]
    df = spark.createDataFrame([(t, i % 2) for i, t in enumerate(texts)], "text string, n int").select(F.parse_json("text").alias("any"), "n", F.lit("x").alias("one"))
    labels = cube.typed_labels(df, ["any"])
    assert sorted(r.label for r in labels.collect()) == sorted(set(texts) - {"null"})
    store.save_typed_config(df, ["any", "n", "one"], str(tmp_path / "c"))
    rows = sorted(store.load_typed_config(spark, str(tmp_path / "c")).collect(), key=lambda r: (r.dim, r.place))
    shown = [r.label.toPython() for r in rows if r.dim == "any"]
    assert [str(v) for v in shown[:4]] == ["-1", "2.5", "3", "10"]
    assert {(type(v), v) for v in shown[4:]} == {(str, "3"), (str, "a"), (str, "true"), (bool, True)}
    assert [r.label.toPython() for r in rows if r.dim == "n"] == [0, 1]
    assert [(r.label.toPython(), r.scalar) for r in rows if r.dim == "one"] == [("x", True)]
    assert cube.typed_summary(df.limit(0), ["any", "n"]).collect() == []
