"""Version order, resolution against a brute-force restatement, and a store on disk."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.plans import catalog
from gridspark.plans.catalog import FieldStore, Version
from gridspark.sources import fields
from tests.test_layout import merges

SCHEMA = "name string, format string, dim_order string, coords boolean, chunk_x string, chunk_y string"
SOURCE = {"format": "grib", "dim_order": "zyx", "coords": True, "chunk_x": "-1", "chunk_y": "-1"}
ATTRS = ("format", "dim_order", "coords")


def spec(text):
    return [int(n) for n in text.split(",")] if "," in text else int(text)


def below(v, r):
    for a in ATTRS:
        if v[a] is not None and r[a] is not None and v[a] != r[a]:
            return False
    return v["format"] != "zarr" or all(
        v[c] is None or r[c] is None or merges(spec(v[c]), spec(r[c])) for c in ("chunk_x", "chunk_y")
    )


def random_rows(n, unset, seed):
    rng = random.Random(seed)

    def pick(*options):
        return None if rng.random() < unset else rng.choice(options)

    return [
        {
            "name": f"v{i:03d}",
            "format": pick("zarr", "netcdf"),
            "dim_order": pick("xyz", "zyx"),
            "coords": pick(True, False),
            "chunk_x": pick("1", "2", "4", "6", "12", "-1", "6,6", "4,8"),
            "chunk_y": pick("1", "3", "9", "-1"),
        }
        for i in range(n)
    ]


@pytest.fixture(scope="module")
def tables(spark):
    versions, requests = random_rows(60, 0.0, 1), random_rows(50, 0.3, 2)
    asked = spark.createDataFrame(requests, SCHEMA).withColumnRenamed("name", "request_id")
    return versions, requests, spark.createDataFrame(versions, SCHEMA), asked


def test_version_order(tables):
    versions, requests, v, r = tables
    got = {x.request_id: x for x in catalog.versions_below(v, r).collect()}
    for q in requests:
        hits = [x["name"] for x in versions if below(x, q)]
        assert got[q["name"]].matches == len(hits), q
        assert got[q["name"]].first_name == (min(hits) if hits else None)


def test_unset_version_attributes(spark):
    versions, requests = random_rows(40, 0.3, 3), random_rows(40, 0.3, 4)
    r = spark.createDataFrame(requests, SCHEMA).withColumnRenamed("name", "request_id")
    got = {x.request_id: x.matches for x in catalog.versions_below(spark.createDataFrame(versions, SCHEMA), r).collect()}
    for q in requests:
        assert got[q["name"]] == sum(below(x, q) for x in versions), q


def test_has_version(tables):
    versions, requests, v, r = tables
    got = {x.request_id for x in catalog.has_version(v, r).collect()}
    names = (*ATTRS, "chunk_x", "chunk_y")
    want = {q["name"] for q in requests if any(all(q[a] is None or q[a] == x[a] for a in names) for x in versions)}
    assert got == want


def test_resolution_takes_a_maximal_version(tables):
    versions, requests, v, r = tables
    got = {x.request_id: x for x in catalog.resolve_versions(v, r, SOURCE).collect()}
    for q in requests:
        fits = [x for x in versions if below(x, q)]
        top = [x for x in fits if not any(below(x, o) and not below(o, x) for o in fits)]
        best = min(top, key=lambda x: x["name"]) if top else {"name": "source", **SOURCE}
        assert got[q["name"]].name == best["name"], q
        for a in (*ATTRS, "chunk_x", "chunk_y"):
            assert got[q["name"]][a] == (best[a] if q[a] is None else q[a])


def test_matching_is_an_equi_join(tables):
    _, _, v, r = tables
    pairs = catalog.match_versions(v, r, catalog.order_rules(v), "zarr")
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert len(joins) == 1 and " = " in joins[0]


# ---------------------------------------------------------------- a store


@pytest.fixture
def store(spark, tmp_path):
    cells = fields.index_grid(spark, {"x": 12, "y": 5, "z": 4})
    cells = cells.withColumns({"a": F.col("x") * 100 + F.col("y") * 10 + F.col("z") * 1.0, "lon": F.col("x") * 0.5})
    calls = []

    def source(version):
        calls.append(version)
        return cells

    made = FieldStore(
        spark, "t", source, Version("grib", "zyx", {"x": -1, "y": -1, "z": 1}, coords=True), str(tmp_path / "s"), ["lon"]
    )
    made.calls = calls
    return made


def rows_of(df):
    return sorted((r.x, r.y, r.z, r.a) for r in df.collect())


def test_store_reuses_finer_chunks(store):
    added = store.add_version(Version("zarr", "xyz", {"x": 3, "y": -1, "z": -1}, "three", False))
    assert added.name == "three" and store.has_version(Version("zarr", "xyz", {"x": 3}))
    before = len(store.calls)
    cells, version = store.get_version(Version("zarr", "xyz", {"x": 6}, coords=False))
    assert version.name == "three" and version.chunks["x"] == 6 and len(store.calls) == before
    assert rows_of(cells) == rows_of(store.source(version))
    assert {(r.x // 6, r.chunk_x) for r in cells.collect()} == {(0, 0), (1, 1)}
    assert "lon" not in cells.columns
    # coarser chunks cannot be split, so the source is used
    assert store.get_version(Version("zarr", "xyz", {"x": 2}, coords=False))[1].name == "source"


def test_store_fills_open_properties(store):
    _, version = store.get_version(Version(dim_order="yxz"))
    assert (version.format, version.coords, version.dim_order) == ("grib", True, "yxz")
    assert version.chunks == {"x": -1, "y": -1, "z": 1}


def test_store_refuses(store):
    assert store.get_version(Version("netcdf", coords=False), create=False) is None
    assert store.get_version(Version("grib"), create=False) is not None
    with pytest.raises(NotImplementedError):
        store.add_version(Version("grib", "xyz", {"x": 1}))
    store.add_version(Version("netcdf", "zyx", {}, "flat", False))
    with pytest.raises(ValueError):
        store.add_version(Version("zarr", "zyx", {"x": 4}, "flat", False))
    same = Version("netcdf", "zyx", {}, "again", False)
    assert store.add_version(same) is same
    assert {r.name for r in store.list_versions().collect()} == {"source", "flat"}
    assert store.get_version(Version("netcdf", "zyx"), weak=False)[1].name == "flat"


def test_store_survives_reopening(spark, store):
    store.add_version(Version("zarr", "xyz", {"x": [5, 7]}, "listed", False))
    again = FieldStore(spark, "t", store.source, store.source_version, store.path, ["lon"])
    cells, version = again.get_version(Version("zarr", "xyz", {"x": -1}))
    assert version.name == "listed" and rows_of(cells) == rows_of(store.source(version))


def test_source_version_must_be_complete(spark):
    with pytest.raises(ValueError):
        FieldStore(spark, "t", lambda v: None, Version("grib", "xyz", {"x": 1, "y": 1, "z": 1}))
    with pytest.raises(ValueError):
        FieldStore(spark, "t", lambda v: None, Version("grib", "xyz", {"x": 1}, coords=True))


def test_requests_meet_matching_versions_only(spark):
    """200 versions with chunks of three dimensions: pairs before the chunk test are versions, not a product of domains."""
    rows = [(f"v{i}", "zarr", "xyz", i % 2 == 0, str(1 + i % 50), str(1 + i % 60), "10,20" if i % 7 == 0 else str(1 + i % 70)) for i in range(200)]
    schema = "name string, format string, dim_order string, coords boolean, chunk_x string, chunk_y string, chunk_z string"
    versions = spark.createDataFrame(rows, schema)
    wanted = [(1, "zarr", None, None, "100", "-1", "30"), (2, None, "xyz", True, None, "120", "10,20"), (3, "netcdf", None, None, None, None, None)]
    requests = spark.createDataFrame(wanted, "request_id int, " + schema.split(", ", 1)[1])
    out = catalog.versions_below(versions, requests)
    got = {r.request_id: r.matches for r in out.collect()}

    def merges(v, r):
        if r is None or r == "-1":
            return True
        if v == "-1":
            return False
        ends = lambda s: np.cumsum([int(n) for n in s.split(",")]).tolist()
        a, b = ends(v), ends(r)
        if len(a) == len(b) == 1:
            return b[0] % a[0] == 0
        if len(a) == 1:
            return all(e % a[0] == 0 or e == b[-1] for e in b)
        if len(b) == 1:
            return sum(e % b[0] == 0 or e == a[-1] for e in a) == -(-a[-1] // b[0])
        return a[-1] == b[-1] and set(b) <= set(a)

    for i, f, d, c, *chunks in wanted:
        fits = [v for v in rows if (f in (None, v[1])) and (d in (None, v[2])) and (c in (None, v[3])) and all(map(merges, v[4:], chunks))]
        assert got[i] == len(fits)
    rules = catalog.order_rules(versions)
    pairs = catalog.match_versions(versions, requests, {a: r for a, r in rules.items() if not a.startswith("chunk_")})
    assert pairs.count() <= 3 * 200


def test_equal_chunks_are_read_without_a_shuffle(spark, tmp_path):
    cells = spark.range(400).select((F.col("id") % 20).alias("x"), (F.floor(F.col("id") / 20)).alias("y"), F.col("id").cast("double").alias("t"))
    source = catalog.Version("grib", "yx", {"x": -1, "y": -1}, "source", True)
    store = catalog.FieldStore(spark, "g", lambda _: cells, source, path=str(tmp_path / "s"))
    store.add_version(catalog.Version("zarr", "xy", {"x": 5}, "fives", False))
    found, version = store.get_version(catalog.Version("zarr", "xy", {"x": 5}, coords=False))
    assert version.name == "fives" and found.count() == 400 and "chunk_x" in found.columns
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    pruned = found.filter("chunk_x = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(chunk_x" in pruned or "chunk_x" in pruned.split("PartitionFilters")[1][:60]
    coarser, _ = store.get_version(catalog.Version("zarr", "xy", {"x": 10}, coords=False))
    assert {r.chunk_x for r in coarser.select("chunk_x").distinct().collect()} == {0, 1}
