"""Queries on runtime measurements: cubes, labels, reductions, speedups, fits and shares."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions import scalars
from gridspark.functions.ieee import NAN
from gridspark.operators import cube, records, reductions, scaling
from gridspark.plans import fixtures as fx
from gridspark.plans.evaluation import evaluate
from gridspark.plans.fixtures import CONFIG, PARTS, with_views
from gridspark.plans.registry import query, r6
from gridspark.session import scratch_path
from gridspark.sources import results as store

DIMS = list(CONFIG)
MEAS = with_views("measurements")
RES = with_views("results")


def _sums(prefix: str = "") -> str:
    return ", ".join(f"round({prefix}{p}, 6) + 0.0e0 AS {p}" for p in PARTS)


def _rounded(parts: list[str] | tuple[str, ...] = PARTS) -> list:
    return [r6(p, p) for p in parts]


# Results by total core count, the smallest runtime among equal products.
CORES = (
    RES.rstrip()
    + """, cored AS (SELECT impl, workers * cores_per_worker AS cores, min(full_rt) AS full_rt, min(compute) AS compute
                     FROM results GROUP BY 1, 2)
"""
)

# Measurements with holes: one configuration is missing, one runtime part is unmeasured there.
GAPS = (
    RES.rstrip()
    + """, gaps AS (SELECT impl, workers, cores_per_worker, full_rt, compute,
                           CASE WHEN impl = 'error' AND workers = 3 THEN CAST('NaN' AS DOUBLE) ELSE serialization END
                             AS serialization FROM results)
"""
)


def _cored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.create_cores_dimension(
        fx.results(spark, sf_dir), DIMS, ["full_rt", "compute"], ["workers", "cores_per_worker"]
    )


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    hole = (F.col("impl") == "error") & (F.col("workers") == 3)
    return fx.results(spark, sf_dir).select(
        *DIMS, "full_rt", "compute", F.when(hole, F.lit(NAN)).otherwise(F.col("serialization")).alias("serialization")
    )


# ---------------------------------------------------------------- measurements to cubes


@query(RES + f"SELECT impl, workers, cores_per_worker, {_sums()} FROM results")
def iteration_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.results(spark, sf_dir).select(*DIMS, *_rounded())


@query(
    MEAS
    + """, dims AS (SELECT * FROM (SELECT DISTINCT impl FROM measurements), (SELECT DISTINCT workers FROM measurements),
                                  (SELECT DISTINCT cores_per_worker FROM measurements)),
         kept AS (SELECT impl, workers, cores_per_worker, max_by(full_rt, event_id) AS full_rt,
                         max_by(compute, event_id) AS compute
                  FROM measurements WHERE NOT (impl = 'error' AND workers = 3) GROUP BY 1, 2, 3)
         SELECT impl, workers, cores_per_worker, round(coalesce(full_rt, -1), 6) + 0.0e0 AS full_rt,
                round(coalesce(compute, -1), 6) + 0.0e0 AS compute
         FROM dims LEFT JOIN kept USING (impl, workers, cores_per_worker)"""
)
def result_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense cube with a hole; the NaN of unmeasured combinations is shown as -1."""
    kept = fx.measurements(spark, sf_dir).filter(~((F.col("impl") == "error") & (F.col("workers") == 3)))
    dense = cube.result_cube(kept, DIMS, ["full_rt", "compute"], "event_id")
    return dense.select(*DIMS, *[r6(F.nanvl(F.col(p), F.lit(-1.0)), p) for p in ("full_rt", "compute")])


@query(
    MEAS
    + """SELECT impl, workers, iterations, warmup
         FROM (SELECT DISTINCT impl FROM measurements), (SELECT DISTINCT workers FROM measurements),
              (VALUES (1), (5)) a(iterations), (VALUES (TRUE)) b(warmup)"""
)
def config_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that occur, combined with given option lists."""
    grid = cube.label_grid(fx.measurements(spark, sf_dir), ["impl", "workers"])
    return cube.add_options(grid, iterations=[1, 5], warmup=True)


@query(RES + f"SELECT impl, workers, cores_per_worker, {_sums()} FROM results WHERE impl <> 'view'")
def results_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "results")
    results = fx.results(spark, sf_dir)
    store.save_results(results, "all", path)
    store.save_results(results.filter("impl <> 'view'"), "some", path)
    return store.load_results(spark, "some", path).select(*DIMS, *_rounded())


@query(
    MEAS
    + """, labels AS (SELECT DISTINCT 'impl' AS dim, impl AS label FROM measurements
                      UNION ALL SELECT DISTINCT 'workers', CAST(workers AS VARCHAR) FROM measurements
                      UNION ALL SELECT DISTINCT 'cores_per_worker', CAST(cores_per_worker AS VARCHAR) FROM measurements
                      UNION ALL SELECT DISTINCT 'warmup', 'true' FROM measurements)
         SELECT dim, label, count(*) OVER (PARTITION BY dim) = 1 AS scalar FROM labels"""
)
def config_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels per dimension, one of them with a single label, written as JSON and read back."""
    rows = fx.measurements(spark, sf_dir).withColumn("warmup", F.lit(True))
    path = scratch_path(spark, "config")
    store.save_config(rows, [*DIMS, "warmup"], path)
    return spark.read.schema("label string, scalar boolean, dim string").json(path).select("dim", "label", "scalar")


@query(
    MEAS
    + """SELECT DISTINCT 'impl' AS dim, impl AS label FROM measurements
         UNION ALL SELECT DISTINCT 'workers', CAST(workers AS VARCHAR) FROM measurements
         UNION ALL SELECT DISTINCT 'cores_per_worker', CAST(cores_per_worker AS VARCHAR) FROM measurements"""
)
def dim_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric labels in the order of their numbers."""
    labels = cube.unpivot_dims(fx.measurements(spark, sf_dir), DIMS)
    return labels.orderBy("dim", F.col("label").try_cast("double"), "label")


@query(
    MEAS
    + """SELECT 'impl' AS dim, count(DISTINCT impl) AS labels FROM measurements
         UNION ALL SELECT 'workers', count(DISTINCT workers) FROM measurements
         UNION ALL SELECT 'cores_per_worker', count(DISTINCT cores_per_worker) FROM measurements"""
)
def varying_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.measurements(spark, sf_dir).withColumn("warmup", F.lit(True))
    return cube.varying_dims(rows, [*DIMS, "warmup"])


@query(CORES + "SELECT impl, cores, round(full_rt, 6) + 0.0e0 AS full_rt, round(compute, 6) + 0.0e0 AS compute FROM cored")
def cores_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cored(spark, sf_dir).select("impl", "cores", *_rounded(["full_rt", "compute"]))


# ---------------------------------------------------------------- labels and columns


@query(
    RES
    + """SELECT CASE impl WHEN 'click' THEN 'C++' WHEN 'view' THEN 'NumPy' ELSE impl END AS impl, workers,
                cores_per_worker, round(full_rt, 6) + 0.0e0 AS full_rt FROM results"""
)
def rename_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cube.rename_labels(fx.results(spark, sf_dir), {"impl": {"click": "C++", "view": "NumPy"}})
    return out.select(*DIMS, r6("full_rt", "full_rt"))


@query(
    RES
    + """SELECT 'L' || CAST(dense_rank() OVER (ORDER BY impl) - 1 AS VARCHAR) AS impl, workers, cores_per_worker,
                round(full_rt, 6) + 0.0e0 AS full_rt FROM results"""
)
def rename_labels_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cube.rename_labels(fx.results(spark, sf_dir), {"impl": ["L0", "L1", "L2", "L3", "L4"]})
    return out.select(*DIMS, r6("full_rt", "full_rt"))


@query(RES + "SELECT impl, workers, cores_per_worker, round(full_rt, 6) + 0.0e0 AS full_rt FROM results WHERE impl NOT IN ('view', 'error')")
def remove_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cube.remove_labels(fx.results(spark, sf_dir), "impl", ["view", "error"])
    return out.select(*DIMS, r6("full_rt", "full_rt"))


@query(
    RES
    + """SELECT impl, workers, cores_per_worker,
                round(compute + graph_construction + optimization + serialization, 6) + 0.0e0 AS no_inp_loading
         FROM results"""
)
def combine_runtimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = ["compute", "graph_construction", "optimization", "serialization"]
    out = cube.combine_runtimes(fx.results(spark, sf_dir), "no_inp_loading", parts)
    return out.select(*DIMS, r6("no_inp_loading", "no_inp_loading"))


@query(
    MEAS
    + """SELECT event_id, impl AS run_impl, workers AS run_workers,
                cores_per_worker AS run_cluster_config_cores_per_worker,
                CASE WHEN workers > 2 THEN 'True' ELSE 'False' END AS run_cluster_config_coords FROM measurements"""
)
def flatten_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.flatten_record(fx.configs(spark, sf_dir))


@query(
    MEAS
    + """SELECT DISTINCT impl || '_' || CAST(workers AS VARCHAR) || '_cores=' || CAST(cores_per_worker AS VARCHAR)
                  || '_fast=' || CASE WHEN workers > 2 THEN 'yes' ELSE 'no' END AS label,
                'repeated_' || CAST(workers AS VARCHAR) AS repeated FROM measurements"""
)
def variant_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.measurements(spark, sf_dir).select(*DIMS).distinct()
    options = F.create_map(
        F.lit("fast"), F.when(F.col("workers") > 2, "yes").otherwise("no"),
        F.lit("cores"), F.col("cores_per_worker").cast("string"),
    )
    label = scalars.variant_label(F.col("impl"), F.array(F.col("workers").cast("string")), options)
    return rows.select(label.alias("label"), scalars.repeated_name(F.col("workers")).alias("repeated")).distinct()


# ---------------------------------------------------------------- reductions


@query(CORES + "SELECT impl, cores, round(min(full_rt), 6) + 0.0e0 AS full_rt FROM cored GROUP BY impl, cores")
def marginal_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cube.marginal(_cored(spark, sf_dir), "impl", "cores", ["full_rt"])
    return out.select("impl", "cores", r6("full_rt", "full_rt"))


@query(
    RES
    + """SELECT impl, 'workers' AS dim, CAST(workers AS VARCHAR) AS label, round(min(full_rt), 6) + 0.0e0 AS full_rt
         FROM results GROUP BY impl, workers
         UNION ALL SELECT impl, 'cores_per_worker', CAST(cores_per_worker AS VARCHAR), round(min(full_rt), 6) + 0.0e0
         FROM results GROUP BY impl, cores_per_worker"""
)
def marginal_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cube.marginal_sets(fx.results(spark, sf_dir), "impl", ["workers", "cores_per_worker"], ["full_rt"])
    return out.select("impl", "dim", "label", r6("full_rt", "full_rt"))


@query(
    GAPS
    + """SELECT impl, workers, cores_per_worker, 'full_rt' AS rt_type, round(full_rt, 6) + 0.0e0 AS runtime FROM gaps
         UNION ALL SELECT impl, workers, cores_per_worker, 'compute', round(compute, 6) + 0.0e0 FROM gaps"""
)
def complete_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cube.complete_series(_gaps(spark, sf_dir), DIMS, ["full_rt", "compute", "serialization"])
    return out.select(*DIMS, "rt_type", r6("runtime", "runtime"))


@query(CORES + "SELECT impl, cores, round(full_rt, 6) + 0.0e0 AS full_rt FROM cored ORDER BY impl, cores")
def sort_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.sort_series(_cored(spark, sf_dir), "impl", "cores").select("impl", "cores", r6("full_rt", "full_rt"))


@query(RES + "SELECT impl, workers, cores_per_worker, round(full_rt, 6) + 0.0e0 AS full_rt FROM results")
def concat_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = fx.results(spark, sf_dir).select(*DIMS, "full_rt")
    out = cube.concat_dim([results.filter("workers > 2"), results.filter("workers <= 2")])
    return out.select(*DIMS, r6("full_rt", "full_rt"))


# ---------------------------------------------------------------- speedups and fits

BASE = (
    CORES.rstrip()
    + """, base AS (SELECT impl, min(cores) AS base_cores, min_by(full_rt, cores) AS base_runtime FROM cored GROUP BY impl),
         series AS (SELECT c.impl, cores, full_rt, base_cores, base_runtime, cores * 1.0e0 / base_cores AS c
                    FROM cored c JOIN base b ON c.impl = b.impl),
         fit AS (SELECT impl, sum((full_rt - base_runtime / c) * ((c - 1) / c))
                              / (base_runtime * sum(((c - 1) / c) * ((c - 1) / c))) AS f
                 FROM series GROUP BY impl, base_runtime)
"""
)


@query(BASE + "SELECT impl, base_cores, round(base_runtime, 6) + 0.0e0 AS base_runtime FROM base")
def speedup_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cube.series_base(_cored(spark, sf_dir), ["impl"], "cores", "full_rt")
    return out.select("impl", "base_cores", r6("base_runtime", "base_runtime"))


@query(BASE + "SELECT impl, cores, round(base_runtime / full_rt, 6) + 0.0e0 AS speedup FROM series")
def speedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cube.speedup(_cored(spark, sf_dir), ["impl"], "cores", "full_rt")
    return out.select("impl", "cores", r6("speedup", "speedup"))


@query(
    CORES
    + """SELECT c.impl, c.cores, round(c.full_rt / r.full_rt, 6) + 0.0e0 AS relative
         FROM cored c LEFT JOIN cored r ON r.cores = c.cores AND r.impl = 'click'"""
)
def relative_runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cube.relative_runtime(_cored(spark, sf_dir), "impl", "cores", "full_rt", "click")
    return out.select("impl", "cores", r6("relative", "relative"))


@query(CORES + "SELECT DISTINCT cores, round(cores * 1.0e0 / (SELECT min(cores) FROM cored), 6) + 0.0e0 AS linear FROM cored")
def linear_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cube.linear_baseline(_cored(spark, sf_dir), "cores")
    return out.select("cores", r6("linear", "linear"))


@query(
    GAPS.replace("full_rt, compute,", "full_rt, input_loading, compute,")
    + """, whole AS (SELECT *, input_loading + compute + serialization AS total FROM gaps WHERE NOT isnan(serialization)),
          long AS (SELECT impl, workers, cores_per_worker, 'input_loading' AS rt_type, 0 AS pos, input_loading / total AS s,
                          0.0e0 AS o FROM whole
                   UNION ALL SELECT impl, workers, cores_per_worker, 'compute', 1, compute / total,
                                    input_loading / total FROM whole
                   UNION ALL SELECT impl, workers, cores_per_worker, 'serialization', 2, serialization / total,
                                    (input_loading + compute) / total FROM whole)
         SELECT impl, workers, cores_per_worker, rt_type, pos, round(s, 6) + 0.0e0 AS share,
                round(o, 6) + 0.0e0 AS "offset" FROM long"""
)
def runtime_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of three parts; the combined column is left out by its metadata, incomplete rows are dropped."""
    hole = (F.col("impl") == "error") & (F.col("workers") == 3)
    results = fx.results(spark, sf_dir).withColumn(
        "serialization", F.when(hole, F.lit(NAN)).otherwise(F.col("serialization"))
    )
    marked = cube.mark_combined(results, "full_rt")
    out = cube.runtime_shares(marked, DIMS, ["full_rt", "input_loading", "compute", "serialization"])
    return out.select(*DIMS, "rt_type", "pos", r6("share", "share"), r6("offset", "offset"))


@query(
    MEAS
    + """SELECT impl, round(regr_intercept(full_rt, workers * cores_per_worker), 6) + 0.0e0 AS alpha,
                round(regr_slope(full_rt, workers * cores_per_worker), 6) + 0.0e0 AS beta
         FROM measurements GROUP BY impl
         UNION ALL SELECT 'all', round(regr_intercept(full_rt, workers * cores_per_worker), 6) + 0.0e0,
                          round(regr_slope(full_rt, workers * cores_per_worker), 6) + 0.0e0 FROM measurements"""
)
def lin_reg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per implementation and over all rows."""
    rows = fx.measurements(spark, sf_dir).withColumn("cores", F.col("workers") * F.col("cores_per_worker"))
    each = scaling.lin_reg(rows, ["impl"], "cores", "full_rt")
    flat = scaling.lin_reg(rows, [], "cores", "full_rt").select(F.lit("all").alias("impl"), "alpha", "beta")
    return each.unionByName(flat).select("impl", r6("alpha", "alpha"), r6("beta", "beta"))


@query(
    BASE
    + """SELECT impl, round(exp(regr_intercept(ln(base_runtime / full_rt), ln(cores))), 6) + 0.0e0 AS alpha,
                round(regr_slope(ln(base_runtime / full_rt), ln(cores)), 6) + 0.0e0 AS beta FROM series GROUP BY impl"""
)
def power_law_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    spd = cube.speedup(_cored(spark, sf_dir), ["impl"], "cores", "full_rt")
    out = scaling.power_law_fit(spd, ["impl"], "cores", "speedup")
    return out.select("impl", r6("alpha", "alpha"), r6("beta", "beta"))


@query(BASE + "SELECT impl, round(f, 6) + 0.0e0 AS serial FROM fit")
def serial_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scaling.serial_fraction(_cored(spark, sf_dir), ["impl"], "cores", "full_rt")
    return out.select("impl", r6("serial", "serial"))


@query(
    CORES.rstrip()
    + """, logs AS (SELECT impl, ln(cores) AS x, ln(full_rt) AS y FROM cored),
          coef AS (SELECT impl, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM logs GROUP BY impl)
         SELECT l.impl, round(-a, 6) + 0.0e0 AS rate, round(b, 6) + 0.0e0 AS factor,
                round(avg(abs((y - (a * x + b)) / y)), 6) + 0.0e0 AS error
         FROM logs l JOIN coef c ON l.impl = c.impl GROUP BY l.impl, a, b"""
)
def scaling_fit_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scaling.scaling_fit_error(_cored(spark, sf_dir), ["impl"], "cores", "full_rt")
    return out.select("impl", r6("rate", "rate"), r6("factor", "factor"), r6("error", "error"))


@query(
    BASE
    + """SELECT s.impl, cores, round(1.0e0 / (f + (1.0e0 - f) / cores), 6) + 0.0e0 AS speedup
         FROM series s JOIN fit ON s.impl = fit.impl"""
)
def amdahl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected speedup on each core count for the fitted serial fraction."""
    cored = _cored(spark, sf_dir)
    fits = scaling.serial_fraction(cored, ["impl"], "cores", "full_rt")
    joined = cored.join(fits, "impl")
    return joined.select("impl", "cores", r6(scalars.amdahl_speedup(F.col("serial"), F.col("cores")), "speedup"))


@query(
    BASE.rstrip()
    + """, span AS (SELECT impl, min(cores) AS x0, max(cores) AS x1 FROM cored GROUP BY impl),
          grid AS (SELECT s.impl, i AS point, x0, x0 + (x1 - x0) * i / 9.9e1 AS x
                   FROM span s, (SELECT CAST(range AS BIGINT) AS i FROM range(100)) r)
         SELECT g.impl, point, round(x, 6) + 0.0e0 AS x,
                round(1.0e0 / (f + (1.0e0 - f) / (x / x0)), 6) + 0.0e0 AS speedup
         FROM grid g JOIN fit ON g.impl = fit.impl"""
)
def scaling_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scaling.scaling_curve(_cored(spark, sf_dir), ["impl"], "cores", "full_rt")
    return out.select("impl", "point", r6("x", "x"), r6("speedup", "speedup"))


@query(
    MEAS
    + """, labels AS (SELECT 'impl' AS dim, impl AS label FROM measurements
                      UNION ALL SELECT 'workers', CAST(workers AS VARCHAR) FROM measurements
                      UNION ALL SELECT 'cores_per_worker', CAST(cores_per_worker AS VARCHAR) FROM measurements)
         SELECT dim, CASE WHEN bool_and(TRY_CAST(label AS DOUBLE) IS NOT NULL) THEN 'line' ELSE 'bar' END AS kind
         FROM labels GROUP BY dim"""
)
def axis_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube.axis_kind(fx.measurements(spark, sf_dir), DIMS)


# ---------------------------------------------------------------- the whole evaluation


@query(
    RES.rstrip()
    + """, named AS (SELECT CASE impl WHEN 'click' THEN 'C++' WHEN 'view' THEN 'NumPy' ELSE impl END AS impl,
                            workers * cores_per_worker AS cores,
                            min(full_rt) AS full_rt, min(compute) AS compute, min(graph_construction) AS graph_construction,
                            min(optimization) AS optimization, min(serialization) AS serialization
                     FROM results WHERE impl <> 'error' GROUP BY 1, 2),
          cored AS (SELECT impl, cores, full_rt, compute + graph_construction + optimization + serialization
                      AS no_inp_loading FROM named),
          base AS (SELECT impl, min(cores) AS base_cores, min_by(full_rt, cores) AS b FROM cored GROUP BY impl),
          series AS (SELECT c.*, b, cores * 1.0e0 / base_cores AS c FROM cored c JOIN base ON c.impl = base.impl),
          fit AS (SELECT impl, sum((full_rt - b / c) * ((c - 1) / c)) / (b * sum(((c - 1) / c) * ((c - 1) / c))) AS f
                  FROM series GROUP BY impl, b)
         SELECT s.impl, s.cores, round(s.full_rt, 6) + 0.0e0 AS full_rt,
                round(s.no_inp_loading, 6) + 0.0e0 AS no_inp_loading, round(b / s.full_rt, 6) + 0.0e0 AS speedup,
                round(s.full_rt / r.full_rt, 6) + 0.0e0 AS relative, round(f, 6) + 0.0e0 AS serial,
                round(1.0e0 / (f + (1.0e0 - f) / c), 6) + 0.0e0 AS expected
         FROM series s JOIN fit ON s.impl = fit.impl LEFT JOIN cored r ON r.cores = s.cores AND r.impl = 'NumPy'"""
)
def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From raw measurements to speedups, relative runtimes and serial fractions."""
    out = evaluate(
        fx.measurements(spark, sf_dir),
        DIMS,
        PARTS,
        contributors=["workers", "cores_per_worker"],
        renames={"click": "C++", "view": "NumPy"},
        removed=["error"],
        combined={"no_inp_loading": ["compute", "graph_construction", "optimization", "serialization"]},
        runtime="full_rt",
        reference="NumPy",
    )
    return out.select(
        "impl", "cores",
        *[r6(c, c) for c in ("full_rt", "no_inp_loading", "speedup", "relative", "serial", "expected")],
    )


@query(
    """SELECT s_suppkey, 'id' AS path, CAST(s_suppkey AS VARCHAR) AS value FROM supplier
       UNION ALL SELECT s_suppkey, 'cluster_cores', CAST(s_suppkey % 8 AS VARCHAR) FROM supplier
       UNION ALL SELECT s_suppkey, 'cluster_limits_n' || CAST(s_nationkey AS VARCHAR) || '_soft', CAST(s_suppkey + 1 AS VARCHAR) FROM supplier
       UNION ALL SELECT s_suppkey, 'cluster_limits_n' || CAST(s_nationkey AS VARCHAR) || '_names', '["a","' || CAST(s_suppkey AS VARCHAR) || '"]' FROM supplier"""
)
def flatten_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structs, a map whose keys differ by row, and lists, four levels deep."""
    supplier = fx.table(spark, sf_dir, "supplier")
    limit = F.struct((F.col("s_suppkey") + 1).alias("soft"), F.array(F.lit("a"), F.col("s_suppkey").cast("string")).alias("names"))
    limits = F.create_map(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), limit)
    cluster = F.struct((F.col("s_suppkey") % 8).alias("cores"), limits.alias("limits"))
    nested = supplier.select("s_suppkey", F.struct(F.col("s_suppkey").alias("id"), cluster.alias("cluster")).alias("record"))
    leaves = records.record_leaves(nested, ["s_suppkey"], "record")
    return leaves.select("s_suppkey", "path", records.leaf_text(F.col("value")).alias("value"))


@query(
    """SELECT p_partkey, 'size' AS path, CAST(p_size AS VARCHAR) AS value FROM part WHERE p_partkey % 3 = 0
       UNION ALL SELECT p_partkey, 'run.grid.x', CAST(p_size AS VARCHAR) FROM part WHERE p_partkey % 3 = 1
       UNION ALL SELECT p_partkey, 'run.grid.chunks', '[' || CAST(p_size AS VARCHAR) || ',{"z":1}]' FROM part WHERE p_partkey % 3 = 1
       UNION ALL SELECT p_partkey, 'run.note', NULL FROM part WHERE p_partkey % 3 = 1
       UNION ALL SELECT p_partkey, 'run.name', 'part' FROM part WHERE p_partkey % 3 = 2"""
)
def flatten_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations as documents whose shape and depth differ from row to row."""
    size = F.col("p_size").cast("string")
    deep = F.concat(F.lit('{"run": {"grid": {"x": '), size, F.lit(', "chunks": ['), size, F.lit(', {"z": 1}]}, "note": null, "none": {}}}'))
    text = (
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('{"size": '), size, F.lit("}")))
        .when(F.col("p_partkey") % 3 == 1, deep)
        .otherwise(F.lit('{"run": {"name": "part"}}'))
    )
    documents = fx.table(spark, sf_dir, "part").select("p_partkey", F.parse_json(text).alias("record"))
    leaves = records.record_leaves(documents, ["p_partkey"], "record", ".")
    return leaves.select("p_partkey", "path", records.leaf_text(F.col("value")).alias("value"))


# ---------------------------------------------------------------- any reduction


def _moments() -> reductions.Mergeable:
    """Standard deviation from counts, means and squared distances, which merge in any order."""

    def merge(a: Sequence[float], b: Sequence[float]) -> Sequence[float]:
        n, apart = a[0] + b[0], b[1] - a[1]
        return (n, a[1] + apart * b[0] / n, a[2] + b[2] + apart * apart * a[0] * b[0] / n) if n else a

    def update(state: Sequence[float], values: np.ndarray) -> Sequence[float]:
        held = values[~np.isnan(values)]
        return merge(state, (len(held), held.mean(), ((held - held.mean()) ** 2).sum())) if len(held) else state

    return reductions.Mergeable((0.0, 0.0, 0.0), update, merge, lambda s: (s[2] / s[0]) ** 0.5 if s[0] else NAN)


@query(
    MEAS
    + f"""SELECT impl, workers, cores_per_worker, {", ".join(f"round(median({p}), 6) + 0.0e0 AS {p}" for p in PARTS)}
          FROM measurements WHERE iteration > 0 GROUP BY ALL"""
)
def iteration_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    reduced = cube.reduce_iterations(fx.measurements(spark, sf_dir), DIMS, PARTS, reduction="nanmedian")
    return reduced.select(*DIMS, *_rounded())


@query(
    MEAS
    + f"""SELECT impl, workers, cores_per_worker, {", ".join(f"round(stddev_pop({p}), 6) + 0.0e0 AS {p}" for p in PARTS)}
          FROM measurements WHERE iteration > 0 GROUP BY ALL"""
)
def iteration_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's reduction, given as states that merge."""
    reduced = cube.reduce_iterations(fx.measurements(spark, sf_dir), DIMS, PARTS, reduction=_moments())
    return reduced.select(*DIMS, *_rounded())


@query(
    MEAS
    + """SELECT impl, 'workers' AS dim, CAST(workers AS VARCHAR) AS label, round(quantile_cont(compute, 9e-1), 6) + 0.0e0 AS compute
         FROM measurements GROUP BY ALL
         UNION ALL SELECT impl, 'cores_per_worker', CAST(cores_per_worker AS VARCHAR), round(quantile_cont(compute, 9e-1), 6) + 0.0e0
         FROM measurements GROUP BY ALL"""
)
def marginal_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ninth decile of all iterations along each dimension."""
    runs = fx.measurements(spark, sf_dir)
    sets = cube.marginal_sets(runs, "impl", ["workers", "cores_per_worker"], ["compute"], reductions.Quantile(0.9))
    return sets.select("impl", "dim", "label", r6("compute", "compute"))


@query(
    CORES
    + """SELECT impl, cores, round(full_rt, 6) + 0.0e0 AS full_rt FROM
         (SELECT impl, workers * cores_per_worker AS cores, max(full_rt) - min(full_rt) AS full_rt FROM results GROUP BY 1, 2)"""
)
def cores_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal products of cores reduced by a function of columns."""
    spread = cube.create_cores_dimension(
        fx.results(spark, sf_dir), DIMS, ["full_rt"], ["workers", "cores_per_worker"], reduction=lambda c: F.max(c) - F.min(c)
    )
    return spread.select("impl", "cores", r6("full_rt", "full_rt"))


# ---------------------------------------------------------------- labels of several types, lists of any depth


@query(
    MEAS
    + """, labels AS (
           SELECT DISTINCT 'impl' AS dim, 'STRING' AS kind, impl AS label, NULL AS number FROM measurements
           UNION ALL SELECT DISTINCT 'workers', 'BIGINT', CAST(workers AS VARCHAR), CAST(workers AS DOUBLE) FROM measurements
           UNION ALL SELECT DISTINCT 'mixed', CASE WHEN event_id % 2 = 0 THEN 'BIGINT' ELSE 'STRING' END,
                                     CAST(event_id % 30 // 2 AS VARCHAR),
                                     CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 30 // 2 AS DOUBLE) END FROM measurements
           UNION ALL SELECT DISTINCT 'warmup', 'BOOLEAN', 'true', CAST(NULL AS DOUBLE) FROM measurements)
         SELECT dim, row_number() OVER (PARTITION BY dim ORDER BY number NULLS LAST, label) - 1 AS place, kind, label,
                count(*) OVER (PARTITION BY dim) = 1 AS scalar FROM labels"""
)
def typed_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels written as JSON and read back with their types; one dimension holds 3 and "3"."""
    runs = fx.measurements(spark, sf_dir)
    half = F.floor(F.col("event_id") % 30 / 2).cast("bigint")
    mixed = F.when(F.col("event_id") % 2 == 0, half.cast("variant")).otherwise(half.cast("string").cast("variant"))
    path = scratch_path(spark, "typed_config")
    store.save_typed_config(runs.withColumns({"mixed": mixed, "warmup": F.lit(True)}), ["impl", "workers", "mixed", "warmup"], path)
    label = F.col("label")
    return store.load_typed_config(spark, path).select(
        "dim", "place", F.schema_of_variant(label).alias("kind"), F.variant_get(label, "$", "string").alias("label"), "scalar"
    )


@query(
    """SELECT p_partkey, place, item FROM (
         SELECT p_partkey, '0' AS place, CAST(p_size AS VARCHAR) AS item FROM part WHERE p_partkey % 3 = 0
         UNION ALL SELECT p_partkey, '0.0', CAST(p_size AS VARCHAR) FROM part WHERE p_partkey % 3 = 1
         UNION ALL SELECT p_partkey, '0.1.0', 'a' FROM part WHERE p_partkey % 3 = 1
         UNION ALL SELECT p_partkey, '0.1.2.0.0', CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 3 = 1
         UNION ALL SELECT p_partkey, '1', NULL FROM part WHERE p_partkey % 3 = 1
         UNION ALL SELECT p_partkey, '', 'part' FROM part WHERE p_partkey % 3 = 2)"""
)
def flat_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists whose depth differs from row to row and from item to item."""
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    text = (
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("["), size, F.lit("]")))
        .when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("[["), size, F.lit(', ["a", [], [['), key, F.lit("]]]], null]")))
        .otherwise(F.lit('"part"'))
    )
    lists = fx.table(spark, sf_dir, "part").select("p_partkey", F.parse_json(text).alias("value"))
    items = records.flat_items(lists, ["p_partkey"], "value")
    place = F.array_join(F.transform("place", lambda i: i.cast("string")), ".")
    return items.select("p_partkey", place.alias("place"), records.leaf_text(F.col("item")).alias("item"))
