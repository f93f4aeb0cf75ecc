"""Queries on gridded fields: scans, structure, alignment, column diagnostics, blocks and storage."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions import scalars
from gridspark.operators import align, averages, blocks, layout, physics, structure
from gridspark.operators.parity import variant_parity as parity
from gridspark.operators.parity import whole_parity
from gridspark.operators.rounds import rounds
from gridspark.plans import catalog
from gridspark.plans import fixtures as fx
from gridspark.plans.fixtures import with_views
from gridspark.plans.registry import query, r6
from gridspark.plans.sweep import sweep
from gridspark.session import scratch_path, store
from gridspark.sources import fields

KEYS = ["col_id"]
CELL = ["col_id", "z"]

# Surface pressure 1e5, gas constants 287.05 and 461.51, heat capacity 1005.
THETA = "pow(1e5 / p, 287.05e0 / 1005e0) * t * (1e0 + (461.51e0 / 287.05e0 - 1e0) * qv / (1e0 - qv))"

GRID = with_views("grid_cells")

# Theta, running sum from the last level, mirrored sum and last level of each column.
BRN_STEPS = f"""
    th AS (SELECT col_id, z, n, hhl - hsurf AS h, u * u + v * v AS w, {THETA} AS theta FROM grid_cells),
    run AS (SELECT th.*, sum(theta) OVER (PARTITION BY col_id ORDER BY z DESC ROWS UNBOUNDED PRECEDING) AS c FROM th),
    brn AS (SELECT a.col_id, a.z, 9.80665e0 * a.h * (a.theta - l.theta) * (a.n - a.z) / (m.c * a.w) AS brn
            FROM run a JOIN run m ON m.col_id = a.col_id AND m.z = a.n - 1 - a.z
                       JOIN run l ON l.col_id = a.col_id AND l.z = a.n - 1)"""


# ---------------------------------------------------------------- scans and sources


@query(
    with_views("field_messages")
    + """SELECT col_id, level, round(value, 6) + 0.0e0 AS t FROM field_messages
         WHERE short_name = 'T' AND type_of_level = 'generalVerticalLayer'"""
)
def field_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = fx.field_messages(spark, sf_dir)
    t = fields.scan_field(messages, "T", ["col_id", "level"], {"type_of_level": "generalVerticalLayer"})
    return t.select("col_id", "level", r6("T", "t"))


@query(
    with_views("field_messages")
    + """SELECT short_name, count(*) AS messages, round(min(value), 6) + 0.0e0 AS low,
                round(max(value), 6) + 0.0e0 AS high FROM field_messages GROUP BY short_name"""
)
def multi_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = fx.field_messages(spark, sf_dir)
    path = scratch_path(spark, "messages")
    messages.withColumn("file", F.col("level") % 2).write.partitionBy("file").parquet(path)
    both = fields.scan_files(spark, [f"{path}/file=0", f"{path}/file=1"])
    return both.groupBy("short_name").agg(F.count("*").alias("messages"), r6(F.min("value"), "low"), r6(F.max("value"), "high"))


@query(
    GRID
    + """SELECT col_id, z AS level, round(p, 6) + 0.0e0 AS p, round(t, 6) + 0.0e0 AS t, round(qv, 6) + 0.0e0 AS qv,
                round(u, 6) + 0.0e0 AS u, round(v, 6) + 0.0e0 AS v FROM grid_cells"""
)
def load_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = fx.field_messages(spark, sf_dir)
    wide = fields.load_fields(
        messages, fields.LAYER_FIELDS, ["col_id", "level"], {"type_of_level": "generalVerticalLayer"}
    )
    return wide.select("col_id", "level", *[r6(n, n.lower()) for n in fields.LAYER_FIELDS])


@query(
    GRID
    + """SELECT col_id, z, round(p, 6) + 0.0e0 AS p, round(t, 6) + 0.0e0 AS t, round(qv, 6) + 0.0e0 AS qv,
                round(u, 6) + 0.0e0 AS u, round(v, 6) + 0.0e0 AS v, round(hhl, 6) + 0.0e0 AS hhl,
                round(hsurf, 6) + 0.0e0 AS hsurf FROM grid_cells"""
)
def brn_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = fx.field_messages(spark, sf_dir)
    assembled = fields.diagnostics_input(messages, KEYS)
    return assembled.select("col_id", "z", *[r6(n, n.lower()) for n in fields.INPUT_NAMES])


def _hash_steps() -> str:
    """The position hash of the synthetic fields, one step per key; ``g`` is the hash of the column's level 0."""
    steps = []
    for i, (r, g) in enumerate((("x", "x"), ("y", "y"), ("z", "0"), ("1", "1"), ("2", "2"))):
        mixed = [f"({s} * 48271 + {k} * 16807 + 12345) % 2147483647" for s, k in (("r", r), ("g", g))]
        steps.append(
            f"f{i + 1} AS (SELECT x, y, z, (a * a + 1) % 2147483647 AS r, (b * b + 1) % 2147483647 AS g "
            f"FROM (SELECT x, y, z, {mixed[0]} AS a, {mixed[1]} AS b FROM f{i}))"
        )
    return ",\n    ".join(steps)


@query(
    GRID.rstrip()
    + f""", f0 AS (SELECT x, y, z, CAST(1234 AS BIGINT) AS r, CAST(1234 AS BIGINT) AS g FROM grid_cells),
    {_hash_steps()}
    SELECT x, y, z, {", ".join(f"round(r / 2147483647e0 + {i} * 0.1e0, 6) + 0.0e0 AS {n}" for i, n in enumerate(fields.INPUT_NAMES[:-1]))},
           round(g / 2147483647e0 + 0.6e0, 6) + 0.0e0 AS HSURF FROM f5"""
)
def fake_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic variables on the positions of the derived grid."""
    made = fields.synthetic_fields(fx.grid_cells(spark, sf_dir), ["x", "y", "z"], seed=1234)
    return made.select("x", "y", "z", *[r6(n, n) for n in fields.INPUT_NAMES])


@query(GRID + "SELECT col_id, z, round(t, 6) + 0.0e0 AS t FROM grid_cells")
def version_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "version")
    fields.write_cells(fx.grid_cells(spark, sf_dir).select("col_id", "z", "t"), path)
    return fields.read_cells(spark, path).select("col_id", "z", r6("t", "t"))


@query(GRID + "SELECT col_id, x, z, round(t, 6) + 0.0e0 AS t FROM grid_cells WHERE x >= 20 AND x < 40")
def chunked_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk predicate prunes directories."""
    path = scratch_path(spark, "chunked")
    cells = layout.with_chunks(fx.grid_cells(spark, sf_dir).select("col_id", "x", "z", "t"), {"x": 10})
    fields.write_chunked(cells, path, ["chunk_x"])
    return fields.read_cells(spark, path).filter(F.col("chunk_x").isin(2, 3)).select("col_id", "x", "z", r6("t", "t"))


# ---------------------------------------------------------------- structure


@query(GRID + "SELECT col_id, z, round(u, 6) + 0.0e0 AS u, round(v, 6) + 0.0e0 AS v FROM grid_cells")
def select_vars(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = structure.select_vars(fx.grid_cells(spark, sf_dir), CELL, ["t", "u", "v"])
    return structure.drop_vars(chosen, ["t"]).select(*CELL, r6("u", "u"), r6("v", "v"))


@query(
    with_views("versions")
    + """SELECT name, dim_order,
                array_to_string(list_transform(string_split(dim_order, ''),
                  lambda k: CASE k WHEN 'x' THEN 'lon' WHEN 'y' THEN 'lat' ELSE 'generalVerticalLayer' END), ',') AS verbose,
                dim_order AS compact FROM versions"""
)
def translate_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"x": "lon", "y": "lat", "z": "generalVerticalLayer"}
    long = fx.versions(spark, sf_dir).withColumn("dims", scalars.expand_order(F.col("dim_order"), names))
    return long.select(
        "name",
        "dim_order",
        F.array_join("dims", ",").alias("verbose"),
        scalars.compact_order(F.col("dims"), names).alias("compact"),
    )


@query(GRID + "SELECT z, y, x, round(t, 6) + 0.0e0 AS t FROM grid_cells")
def transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fx.grid_cells(spark, sf_dir).select("x", "y", "z", "t")
    return structure.transpose(cells, ["z", "y", "x"]).withColumn("t", r6("t", "t"))


@query(GRID + "SELECT col_id, z, round(t, 6) + 0.0e0 AS t FROM grid_cells WHERE z = n - 1")
def isel_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fx.grid_cells(spark, sf_dir).select("col_id", "z", "t")
    return structure.isel(cells, "z", -1, KEYS).select(*CELL, r6("t", "t"))


@query(GRID + "SELECT col_id, n - 1 - z AS z, round(t, 6) + 0.0e0 AS t FROM grid_cells")
def isel_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fx.grid_cells(spark, sf_dir).select("col_id", "z", "t")
    return structure.isel_reverse(cells, "z", KEYS).select(*CELL, r6("t", "t"))


@query(GRID + "SELECT col_id, z - 1 AS z, round(t, 6) + 0.0e0 AS t FROM grid_cells WHERE z >= 1 AND z < 3")
def isel_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fx.grid_cells(spark, sf_dir).select("col_id", "z", "t")
    return structure.isel_range(cells, "z", 1, 3).select(*CELL, r6("t", "t"))


@query(with_views("surface") + "SELECT CAST(0 AS BIGINT) AS z, y, x, round(hsurf, 6) + 0.0e0 AS hsurf FROM surface")
def adjust_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surface with a time dimension of size 1 brought to the dimensions z, y, x."""
    timed = fx.surface(spark, sf_dir).select("x", "y", F.lit(0).alias("time"), "hsurf")
    out = structure.adjust_dims(timed, ["x", "y", "time"], ["z", "y", "x"])
    return out.withColumn("hsurf", r6("hsurf", "hsurf"))


@query(with_views("surface") + "SELECT x, y, round(hsurf, 6) + 0.0e0 AS hsurf FROM surface")
def drop_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = fx.surface(spark, sf_dir).select(
        "x", "y", "hsurf", (F.col("x") * 0.25).alias("lon"), (F.col("y") * 0.5).alias("lat")
    )
    return structure.drop_coords(labelled, ["lon", "lat"]).withColumn("hsurf", r6("hsurf", "hsurf"))


@query(GRID + "SELECT col_id, z, round(t + 1.25e-1, 6) + 0.0e0 AS t, round(u + 1.25e-1, 6) + 0.0e0 AS u FROM grid_cells")
def perturb(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fx.grid_cells(spark, sf_dir).select("col_id", "z", "t", "u")
    return structure.perturb(cells, ["t", "u"], 0.125).select(*CELL, r6("t", "t"), r6("u", "u"))


# ---------------------------------------------------------------- alignment


@query(
    GRID
    + """SELECT col_id, z, round(coalesce(CASE WHEN z < 2 THEN p END, -1.0e0), 6) + 0.0e0 AS p,
                round(coalesce(CASE WHEN z > 0 THEN t END, -1.0e0), 6) + 0.0e0 AS t FROM grid_cells"""
)
def merge_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two variables on overlapping levels; the NaN of absent positions is shown as -1."""
    cells = fx.grid_cells(spark, sf_dir)
    low, high = cells.filter("z < 2").select(*CELL, "p"), cells.filter("z > 0").select(*CELL, "t")
    merged = align.merge_fields([low, high], CELL)
    return merged.select(*CELL, *[r6(F.nanvl(F.col(c), F.lit(-1.0)), c) for c in ("p", "t")])


@query(GRID + "SELECT col_id, z, round(t * hsurf, 6) + 0.0e0 AS weighted FROM grid_cells")
def broadcast_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fx.grid_cells(spark, sf_dir).select(*CELL, "t")
    flat = fx.surface(spark, sf_dir).select("col_id", "hsurf")
    return align.with_surface(cells, flat, KEYS).select(*CELL, r6(F.col("t") * F.col("hsurf"), "weighted"))


@query(GRID + "SELECT col_id, z, round(t * u, 6) + 0.0e0 AS product FROM grid_cells WHERE z > 0")
def align_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fx.grid_cells(spark, sf_dir)
    both = align.align_fields(cells.select(*CELL, "t"), cells.filter("z > 0").select(*CELL, "u"), CELL)
    return both.select(*CELL, r6(F.col("t") * F.col("u"), "product"))


# ---------------------------------------------------------------- diagnostics


@query(GRID + f"SELECT col_id, z, round({THETA}, 6) + 0.0e0 AS thetav FROM grid_cells")
def thetav(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = physics.thetav(fx.grid_cells(spark, sf_dir), CELL)
    return out.select(*CELL, r6("thetav", "thetav"))


@query(GRID.rstrip() + "," + BRN_STEPS + " SELECT col_id, z, round(brn, 6) + 0.0e0 AS brn FROM brn")
def brn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return physics.brn(fx.grid_cells(spark, sf_dir), KEYS).select(*CELL, r6("brn", "brn"))


@query(
    GRID.rstrip() + "," + BRN_STEPS
    + """ SELECT a.col_id, a.z, round(9.80665e0 * a.h * (a.theta - l.theta) * (a.n - a.z) / (a.c * a.w), 6) + 0.0e0 AS brn
          FROM run a JOIN run l ON l.col_id = a.col_id AND l.z = a.n - 1"""
)
def brn_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return physics.brn(fx.grid_cells(spark, sf_dir), KEYS, aligned=True).select(*CELL, r6("brn", "brn"))


def _variant(name: str) -> None:
    sql = GRID.rstrip() + "," + BRN_STEPS + " SELECT col_id, z, round(brn, 6) + 0.0e0 AS brn FROM brn"

    @query(sql, name=name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return physics.BRN_VARIANTS[name](fx.grid_cells(spark, sf_dir), KEYS).select(*CELL, r6("brn", "brn"))


for _name in physics.BRN_VARIANTS:
    _variant(_name)


@query(GRID + f"SELECT col_id, z, round({THETA}, 6) + 0.0e0 AS thetav FROM grid_cells")
def thetav_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = physics.thetav_arrow(fx.grid_cells(spark, sf_dir), CELL)
    return out.select(*CELL, r6("thetav", "thetav"))


@query(
    GRID.rstrip() + "," + BRN_STEPS
    + " SELECT col_id, n - 1 - z AS z, round(c, 6) + 0.0e0 AS theta_sum FROM run"
)
def vertical_cumsum_rev(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fx.grid_cells(spark, sf_dir)
    out = physics.vertical_cumsum_rev(cells, physics._theta(), KEYS, "theta_sum")
    return out.select(*CELL, r6("theta_sum", "theta_sum"))


@query(GRID + "SELECT col_id, z, n - z AS levels FROM grid_cells")
def level_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return physics.level_count(fx.grid_cells(spark, sf_dir), KEYS)


@query(
    GRID.rstrip() + "," + BRN_STEPS
    + """ SELECT a.col_id, a.z, round(a.theta - l.theta, 6) + 0.0e0 AS anomaly
          FROM th a JOIN th l ON l.col_id = a.col_id AND l.z = a.n - 1"""
)
def last_level_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = physics.last_level_anomaly(fx.grid_cells(spark, sf_dir), physics._theta(), KEYS)
    return out.select(*CELL, r6("anomaly", "anomaly"))


@query(GRID + "SELECT col_id, z, round(u * u + v * v, 6) + 0.0e0 AS wind_sq, round(hhl - hsurf, 6) + 0.0e0 AS height FROM grid_cells")
def wind_sq(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = physics.wind_and_height(fx.grid_cells(spark, sf_dir), CELL)
    return out.select(*CELL, r6("wind_sq", "wind_sq"), r6("height", "height"))


@query(
    GRID.rstrip() + "," + BRN_STEPS
    + f""", g2 AS (SELECT g.col_id, g.z, g.n, b.brn AS p, t, qv, hhl - hsurf AS h, u * u + v * v AS w
                   FROM grid_cells g JOIN brn b ON b.col_id = g.col_id AND b.z = g.z),
           th2 AS (SELECT g2.*, CASE WHEN p < 0 THEN CAST('NaN' AS DOUBLE) WHEN p = 0 THEN CAST('Infinity' AS DOUBLE)
                                ELSE {THETA} END AS theta FROM g2),
           run2 AS (SELECT th2.*, sum(theta) OVER (PARTITION BY col_id ORDER BY z DESC ROWS UNBOUNDED PRECEDING) AS c
                    FROM th2),
           brn2 AS (SELECT a.col_id, a.z, 9.80665e0 * a.h * (a.theta - l.theta) * (a.n - a.z) / (m.c * a.w) AS brn
                    FROM run2 a JOIN run2 m ON m.col_id = a.col_id AND m.z = a.n - 1 - a.z
                                JOIN run2 l ON l.col_id = a.col_id AND l.z = a.n - 1)
         SELECT col_id, z, isnan(brn) AS is_nan, CASE WHEN isnan(brn) THEN 0.0e0 ELSE round(brn, 6) + 0.0e0 END AS brn
         FROM brn2"""
)
def brn_repeat2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the second round on every cell is NaN: the last level's theta becomes infinite."""
    out = physics.repeated_brn(fx.grid_cells(spark, sf_dir), KEYS, 2)
    value = F.when(F.isnan("brn"), 0.0).otherwise(F.round("brn", 6) + 0.0)
    return out.select(*CELL, F.isnan("brn").alias("is_nan"), value.alias("brn"))


@query(
    GRID
    + f"""SELECT col_id, z, round({THETA}, 6) + 0.0e0 AS thetav
          FROM (SELECT col_id, z, p, qv, {THETA} AS t
                FROM (SELECT col_id, z, p, qv, {THETA} AS t FROM grid_cells) a) b"""
)
def thetav_iterate3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = physics.iterate_thetav(fx.grid_cells(spark, sf_dir), CELL, 3)
    return out.select(*CELL, r6("thetav", "thetav"))


def _with_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid with NaN temperatures at every seventh position along x."""
    return fx.grid_cells(spark, sf_dir).withColumn("t", F.when(F.col("x") % 7 == 3, F.lit(float("nan"))).otherwise(F.col("t")))


@query(
    GRID
    + """SELECT y, z, round(coalesce(avg(CASE WHEN x % 7 <> 3 THEN t END), -1.0e0), 6) + 0.0e0 AS t
         FROM grid_cells GROUP BY y, z"""
)
def avg_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NaN is skipped; a mean of nothing else is shown as -1."""
    out = averages.avg_dim(_with_holes(spark, sf_dir), "t", ["y", "z"])
    return out.select("y", "z", r6(F.nanvl(F.col("t"), F.lit(-1.0)), "t"))


@query(
    GRID
    + """SELECT y, z, round(coalesce((avg(CASE WHEN x < 50 AND x % 7 <> 3 THEN t END)
                                     + avg(CASE WHEN x >= 50 AND x % 7 <> 3 THEN t END)) / 2, -1.0e0), 6) + 0.0e0 AS t
         FROM grid_cells GROUP BY y, z"""
)
def avg_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = averages.avg_split(_with_holes(spark, sf_dir), "t", "x", 100, ["y", "z"])
    return out.select("y", "z", r6(F.nanvl(F.col("t"), F.lit(-1.0)), "t"))


@query(
    GRID
    + """SELECT variant, count(*) AS cells, CAST(0 AS BIGINT) AS unmatched, TRUE AS close
         FROM grid_cells, (VALUES ('brn_arrow'), ('brn_windows'), ('brn_segmented'), ('thetav_arrow')) AS t(variant) GROUP BY variant"""
)
def variant_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All implementations of the Richardson number against the profile form, and those of theta against the first.

    Parts of whole columns are compared one after the other, so that the shuffles of all forms hold one part at a time.
    """
    path = scratch_path(spark, "parity")
    first, *others = physics.THETAV_VARIANTS
    for cells in rounds(fx.grid_cells(spark, sf_dir), KEYS):
        forms = {n: f(cells, KEYS) for n, f in physics.BRN_VARIANTS.items()}
        expected = forms.pop("brn_profile")
        store(parity(expected, forms, CELL, "brn", atol=1e-9, rtol=1e-7), path, "append")
        thetas = {n: physics.THETAV_VARIANTS[n](cells, CELL) for n in others}
        of_theta = parity(physics.THETAV_VARIANTS[first](cells, CELL), thetas, CELL, "thetav", atol=1e-9, rtol=1e-7)
        store(of_theta, path, "append")
    reports = spark.read.schema(of_theta.schema).parquet(path)
    return whole_parity(reports).select("variant", "cells", "unmatched", "close")


# ---------------------------------------------------------------- chunks of fields


@query(
    GRID
    + """SELECT col_id, x, z, CAST(floor(x / 8) AS BIGINT) AS chunk_x,
                CAST(CASE WHEN x < 30 THEN 0 WHEN x < 80 THEN 1 ELSE 2 END AS BIGINT) AS list_chunk FROM grid_cells"""
)
def assign_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fx.grid_cells(spark, sf_dir).select("col_id", "x", "z")
    by_list = layout.with_chunks(cells, {"x": [30, 50, 20]}).withColumnRenamed("chunk_x", "list_chunk")
    return layout.with_chunks(by_list, {"x": 8}).select("col_id", "x", "z", "chunk_x", "list_chunk")


@query(
    GRID
    + """SELECT CAST(floor(x / 10) AS BIGINT) AS chunk_x, CAST(floor(y / 25) AS BIGINT) AS chunk_y, count(*) AS cells,
                CAST(1 AS BIGINT) AS partitions FROM grid_cells GROUP BY 1, 2"""
)
def rechunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fx.grid_cells(spark, sf_dir).select("x", "y", "z", "t")
    placed = layout.rechunk(cells, {"x": 10, "y": 25}).withColumn("place", F.spark_partition_id())
    return placed.groupBy("chunk_x", "chunk_y").agg(
        F.count("*").alias("cells"), F.count_distinct("place").alias("partitions")
    )


@query(
    GRID
    + """SELECT z, y, x, CAST(floor(x / 10) AS BIGINT) AS chunk_x, round(t, 6) + 0.0e0 AS t FROM grid_cells"""
)
def impose_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fx.grid_cells(spark, sf_dir).select("x", "y", "z", "t", (F.col("x") * 0.25).alias("lon"))
    version = catalog.Version(dim_order="zyx", chunks={"x": 10, "y": None}, coords=False)
    out = catalog.impose(cells, version, coords=["lon"])
    return out.select("z", "y", "x", "chunk_x", r6("t", "t"))


@query(
    GRID
    + """SELECT CAST(floor(x / 20) AS BIGINT) AS chunk_x, count(*) AS cells, 'by-ten' AS version,
                round(avg(t), 6) + 0.0e0 AS mean_t FROM grid_cells GROUP BY 1"""
)
def add_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store two versions of the derived grid, ask for a third and read it from the closest stored one."""
    source_version = catalog.Version("grib", "zyx", {"x": -1, "y": -1, "z": -1}, "source", True)
    cells = fx.grid_cells(spark, sf_dir).select("x", "y", "z", "t")
    store = catalog.FieldStore(spark, "grid", lambda _: cells, source_version)
    store.add_version(catalog.Version("zarr", "xyz", {"x": 10}, "by-ten", False))
    store.add_version(catalog.Version("netcdf", "zyx", {}, "flat", False))
    found, version = store.get_version(catalog.Version("zarr", "xyz", {"x": 20}, coords=False))
    return found.groupBy(F.col("chunk_x").cast("bigint").alias("chunk_x")).agg(
        F.count("*").alias("cells"), F.lit(version.name).alias("version"), r6(F.avg("t"), "mean_t")
    )


# ---------------------------------------------------------------- user functions on blocks


@query(GRID + f"SELECT col_id, z, round({THETA}, 6) + 0.0e0 AS thetav FROM grid_cells")
def map_blocks_np(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A NumPy function on chunks of many columns; depth is cut too, so a deep column spreads over chunks."""
    chunks = {"col_id": 1024, "z": 1024}
    out = blocks.map_blocks(physics._block_thetav, fx.grid_cells(spark, sf_dir), CELL, ["p", "t", "qv"], chunks, "thetav")
    return out.select(*CELL, r6("thetav", "thetav"))


@query(GRID + f"SELECT col_id, z, round({THETA}, 6) + 0.0e0 AS thetav FROM grid_cells")
def map_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same function on Arrow batches: element-wise, hence without a shuffle."""
    out = blocks.map_cells(physics._block_thetav, fx.grid_cells(spark, sf_dir), CELL, ["p", "t", "qv"], "thetav")
    return out.select(*CELL, r6("thetav", "thetav"))


@query(GRID + "SELECT col_id, z, round(t * hsurf + 5.0e-1 * z + 2.5e-1 * x, 6) + 0.0e0 AS tilted FROM grid_cells")
def map_blocks_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function that sees positions, a label coordinate and a lower-dimensional variable of its chunk."""

    def tilt(chunk: pd.DataFrame) -> pd.Series:
        return chunk["t"] * chunk["hsurf"] + 0.5 * chunk.index.get_level_values("z") + chunk["lon"]

    cells = fx.grid_cells(spark, sf_dir).withColumn("lon", F.col("x") * 0.25)
    chunks = {"col_id": 1024, "z": 1024}
    out = blocks.map_blocks_coords(tilt, cells, CELL, ["t", "hsurf"], chunks, "tilted", coords=["lon"])
    return out.select(*CELL, r6("tilted", "tilted"))


@query()
def experiment_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both theta implementations on two layouts of the derived grid, timed as Spark jobs."""
    path = scratch_path(spark, "sweep")
    cells = fx.grid_cells(spark, sf_dir).select("col_id", "x", "z", "p", "t", "qv")
    fields.write_cells(cells, f"{path}/flat")
    fields.write_chunked(layout.with_chunks(cells, {"x": 25}), f"{path}/chunked", ["chunk_x"])
    operators = {n: (lambda df, f=f: f(df, CELL)) for n, f in physics.THETAV_VARIANTS.items()}
    inputs = {n: (lambda n=n: fields.read_cells(spark, f"{path}/{n}")) for n in ("flat", "chunked")}
    return sweep(spark, operators, inputs, iterations=2)


# ---------------------------------------------------------------- variables of different dimensions, layouts as tables


@query(
    GRID
    + """, vol AS (SELECT coalesce(a.col_id, b.col_id) AS col_id, coalesce(a.z, b.z) AS z, t, u
                   FROM (SELECT col_id, z, t FROM grid_cells WHERE z < 3) a
                   FULL JOIN (SELECT col_id, z, u FROM grid_cells WHERE z > 0) b ON a.col_id = b.col_id AND a.z = b.z),
    flat AS (SELECT o_orderkey AS col_id, o_totalprice * 1.0e-3 AS hsurf FROM orders WHERE o_orderkey % 3 <> 0),
    levels AS (SELECT z, avg(p) AS base FROM grid_cells WHERE z > 1 GROUP BY z),
    zs AS (SELECT z FROM vol UNION SELECT z FROM levels), cols AS (SELECT col_id FROM vol UNION SELECT col_id FROM flat),
    top AS (SELECT max(p) AS highest FROM grid_cells)
    SELECT 'cells' AS part, col_id, z, round(coalesce(t, -1e0), 6) + 0.0e0 AS t, round(coalesce(u, -999e0), 6) + 0.0e0 AS u,
           round(coalesce(hsurf, -1e0), 6) + 0.0e0 AS hsurf, round(coalesce(base, -1e0), 6) + 0.0e0 AS base,
           round((SELECT highest FROM top), 6) + 0.0e0 AS highest
    FROM vol LEFT JOIN flat USING (col_id) LEFT JOIN levels USING (z)
    UNION ALL SELECT 'columns', col_id, NULL, NULL, NULL, round(coalesce(hsurf, -1e0), 6) + 0.0e0, NULL, NULL
    FROM cols LEFT JOIN flat USING (col_id)
    UNION ALL SELECT 'levels', NULL, z, NULL, NULL, NULL, round(coalesce(base, -1e0), 6) + 0.0e0, NULL
    FROM zs LEFT JOIN levels USING (z)"""
)
def merge_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables on (column, level), on columns, on levels and a single value; gaps are shown as negative numbers."""
    cells = fx.grid_cells(spark, sf_dir)
    ground = fx.surface(spark, sf_dir).where("col_id % 3 <> 0").select("col_id", "hsurf")
    base = cells.where("z > 1").groupBy("z").agg(F.avg("p").alias("base"))
    merged = align.merge_dataset(
        [
            cells.where("z < 3").select(*CELL, "t"), cells.where("z > 0").select(*CELL, "u"), ground, base,
            cells.agg(F.max("p").alias("highest")),
        ],
        CELL,
    )
    gap = {"t": -1.0, "u": -999.0, "hsurf": -1.0, "base": -1.0}
    columns = ["part", *CELL, *gap, "highest"]
    shown = {v: F.round(F.nanvl(v, F.lit(g)), 6) + F.lit(0.0) for v, g in gap.items()}

    def part(name: str, table: DataFrame) -> DataFrame:
        own = table.withColumns({v: c for v, c in shown.items() if v in table.columns})
        absent = {c: F.lit(None).cast("bigint" if c in CELL else "double") for c in columns[1:] if c not in table.columns}
        return own.withColumns(absent).withColumn("part", F.lit(name)).select(columns)

    volume = merged.cells([*gap, "highest"]).withColumn("highest", r6("highest", "highest"))
    return part("cells", volume).union(part("columns", merged.along("col_id"))).union(part("levels", merged.along("z")))


@query(
    GRID
    + """SELECT col_id, z, CAST(floor(t + 2 * hsurf) AS BIGINT) AS whole, round(t * 2 + hsurf + z, 6) + 0.0e0 AS scaled
         FROM grid_cells"""
)
def map_arrays_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of a volume and a surface array, with a keyword argument, coordinates and two results of other types."""

    def combine(t, ground, factor, coords):
        both = t * factor + ground[:, None] + coords["z"]
        return np.floor(np.nan_to_num(t + 2 * ground[:, None])).astype("int64"), both.astype("float64")

    cells, ground = fx.grid_cells(spark, sf_dir), fx.surface(spark, sf_dir)
    arrays = [blocks.Array(cells, CELL, "t"), blocks.Array(ground, KEYS, "hsurf")]
    chunks = {"col_id": 1024, "z": 512}
    out = blocks.map_arrays(combine, arrays, chunks, [("whole", "bigint"), ("scaled", "double")], with_coords=True, factor=2)
    return out.select(*CELL, "whole", r6("scaled", "scaled"))


@query(
    GRID
    + """SELECT col_id, CAST(count(*) AS INTEGER) AS levels, round(max(t) - min(t), 3) + 0.0e0 AS spread
         FROM grid_cells GROUP BY col_id"""
)
def map_arrays_reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function that reduces the vertical axis; its results have the dimensions and types of the template."""

    def summary(t):
        with np.errstate(all="ignore"):
            return (~np.isnan(t)).sum(axis=1), np.nanmax(t, axis=1) - np.nanmin(t, axis=1)

    arrays = [blocks.Array(fx.grid_cells(spark, sf_dir), CELL, "t")]
    out = blocks.map_arrays(summary, arrays, {"col_id": 1024, "z": -1}, [("levels", "int"), ("spread", "float")], KEYS)
    return out.select(*KEYS, "levels", (F.round(F.col("spread").cast("double"), 3) + F.lit(0.0)).alias("spread"))


@query(
    """WITH layouts AS (SELECT p_partkey AS layout_id, [1 + (p_partkey * i) % 7 FOR i IN range(1, p_size + 1)] AS sizes FROM part),
       chunks AS (SELECT layout_id, i - 1 AS chunk, list_sum(sizes[1:i]) AS stop, sizes[i] AS n
                  FROM (SELECT *, unnest(range(1, len(sizes) + 1)) AS i FROM layouts))
       SELECT l_orderkey, l_linenumber, l_partkey AS layout_id, l_orderkey % 150 AS position,
              CAST((SELECT chunk FROM chunks WHERE layout_id = l_partkey AND l_orderkey % 150 >= stop - n AND l_orderkey % 150 < stop)
                   AS BIGINT) AS chunk_position FROM lineitem"""
)
def assign_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part is a layout with its own list of chunk sizes; lines are positions in the layout of their part."""
    part = fx.table(spark, sf_dir, "part")
    listed = F.transform(F.sequence(F.lit(1), F.col("p_size").cast("int")), lambda i: 1 + (F.col("p_partkey") * i) % 7)
    layouts = part.select(F.col("p_partkey").alias("layout_id"), listed.alias("sizes"))
    cells = fx.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("layout_id"), (F.col("l_orderkey") % 150).alias("position")
    )
    return layout.assign_by_layout(cells, layouts, ["layout_id"], "sizes", "position")


# ---------------------------------------------------------------- files that differ, labelled axes, placed chunks


@query(
    GRID
    + """SELECT col_id, z, round(CASE WHEN z < 4 THEN t ELSE -1e0 END, 6) + 0.0e0 AS t,
                round(CASE WHEN z > 1 OR z = 0 THEN u ELSE -999e0 END, 6) + 0.0e0 AS u,
                CASE WHEN z > 1 THEN n END AS n, z IN (2, 3) AS twice
         FROM grid_cells"""
)
def multi_file_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sets of files: levels overlap, each lacks variables, and one has NaN where another has values."""
    cells = fx.grid_cells(spark, sf_dir)
    path = scratch_path(spark, "overlapping")
    cells.where("z < 4").select(*CELL, "t").write.parquet(f"{path}/low")
    cells.where("z > 1").select(*CELL, F.when(F.col("z") < 4, F.col("t")).otherwise(F.lit(np.nan)).alias("t"), "u", "n").write.parquet(f"{path}/high")
    cells.where("z < 3").select(*CELL, F.when(F.col("z") == 0, F.col("u")).otherwise(F.lit(np.nan)).alias("u")).write.parquet(f"{path}/gaps")
    both = fields.scan_aligned(spark, [f"{path}/{part}" for part in ("low", "high", "gaps")], CELL)
    shown = [r6(F.nanvl(v, F.lit(gap)), v) for v, gap in (("t", -1.0), ("u", -999.0))]
    return both.select(*CELL, *shown, "n", F.col("z").isin(2, 3).alias("twice"))


@query(
    GRID
    + """, a AS (SELECT col_id, 100 - 10 * z AS height, z, t FROM grid_cells WHERE z <> 2),
    b AS (SELECT col_id, 100 - 10 * z AS height, u FROM grid_cells WHERE z > 0),
    shared AS (SELECT height, row_number() OVER (ORDER BY min(z)) - 1 AS z FROM a
               WHERE height IN (SELECT height FROM b) GROUP BY height)
    SELECT col_id, CAST(s.z AS BIGINT) AS z, CAST(height AS BIGINT) AS height, round(t * u, 6) + 0.0e0 AS product
    FROM a JOIN b USING (col_id, height) JOIN shared s USING (height)"""
)
def align_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fields whose levels are numbered apart but labelled alike: one lacks a level, the other starts a level later."""
    cells = fx.grid_cells(spark, sf_dir).withColumn("height", F.lit(100) - 10 * F.col("z"))
    first = cells.where("z <> 2").withColumn("z", F.when(F.col("z") > 2, F.col("z") - 1).otherwise(F.col("z")))
    later = cells.where("z > 0").withColumn("z", F.col("z") - 1)
    both = align.align_labels(first.select(*CELL, "height", "t"), later.select(*CELL, "height", "u"), CELL, {"z": "height"})
    return both.select(*CELL, F.col("height").cast("bigint").alias("height"), r6(F.col("t") * F.col("u"), "product"))


@query(
    GRID
    + """SELECT x // 10 AS chunk_x, z, count(*) AS cells, round(avg(t * u), 6) + 0.0e0 AS mean_product
         FROM grid_cells WHERE z > 0 GROUP BY 1, 2"""
)
def placed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fields stored with equal chunks, joined by cell and averaged by chunk and level where they lie."""
    session = fields.placed_session(spark)
    cells = layout.with_chunks(fx.grid_cells(spark, sf_dir), {"x": 10})
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tables = []
    for variable, kept in (("t", cells), ("u", cells.where("z > 0"))):
        path = scratch_path(spark, f"placed_{variable}")
        tables.append(path.rsplit("/", 1)[1].replace("-", "_"))
        fields.write_placed(kept.select("chunk_x", *CELL, variable), tables[-1], path, ["chunk_x"], CELL, buckets)
    t, u = (session.table(name) for name in tables)
    mean = r6(F.avg(F.col("t") * F.col("u")), "mean_product")
    return t.join(u, ["chunk_x", *CELL]).groupBy(F.col("chunk_x").cast("bigint").alias("chunk_x"), "z").agg(F.count("*").alias("cells"), mean)
