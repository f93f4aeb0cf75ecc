"""Queries on chunk layouts, the version catalogue, configuration records and scalar helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions import chunks as ch
from gridspark.functions import scalars
from gridspark.operators import layout, records
from gridspark.plans import catalog
from gridspark.plans import fixtures as fx
from gridspark.plans.fixtures import with_views
from gridspark.plans.registry import query
from gridspark.session import scratch_path

LAY = with_views("layouts")
VER = with_views("versions")
REQ = with_views("versions", "requests")

# Three consecutive layouts are the dimensions x, y, z of one dataset.
DIM = "CASE layout_id % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'y' ELSE 'z' END"
SET = "CAST((layout_id - layout_id % 3) / 3 AS BIGINT)"


def _by_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = F.when(F.col("layout_id") % 3 == 0, "x").when(F.col("layout_id") % 3 == 1, "y").otherwise("z")
    dataset = F.floor(F.col("layout_id") / 3).cast("bigint")
    return fx.layouts(spark, sf_dir).withColumns({"dim": dim, "dataset": dataset})


# ---------------------------------------------------------------- chunk layouts


@query(
    LAY
    + """SELECT layout_id, CASE WHEN layout_id % 19 = 0 THEN -1 ELSE spec1 END AS spec FROM layouts
         WHERE layout_id % 19 = 0 OR spec1 IS NOT NULL"""
)
def simplify_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("layout_id") % 19 == 0, "auto").otherwise(F.col("spec1").cast("string"))
    specs = fx.layouts(spark, sf_dir).select("layout_id", F.create_map(F.lit("x"), text).alias("chunks"))
    simple = specs.select("layout_id", F.explode(ch.simplify_map(F.col("chunks"))).alias("dim", "spec"))
    return simple.select("layout_id", "spec")


CHUNKS = """, sized AS (SELECT layout_id, dim_size, CASE WHEN spec1 = -1 THEN dim_size ELSE spec1 END AS s
                        FROM layouts WHERE spec1 IS NOT NULL),
         pieces AS (SELECT layout_id, dim_size, s, unnest(range(CAST(ceil(dim_size * 1.0e0 / s) AS BIGINT))) AS i FROM sized)
"""


@query(
    LAY.rstrip() + CHUNKS
    + "SELECT layout_id, i AS chunk_idx, i * s AS start, least(s, dim_size - i * s) AS size FROM pieces"
)
def chunk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.explode_chunks(fx.layouts(spark, sf_dir), ["layout_id"], F.col("spec1"), F.col("dim_size"))


@query(
    LAY
    + f"""SELECT {SET} AS dataset,
                 bool_and(spec1 IS NULL OR spec2 IS NULL
                          OR CASE WHEN spec1 = -1 OR spec1 > dim_size THEN dim_size ELSE spec1 END
                             = CASE WHEN spec2 = -1 OR spec2 > dim_size THEN dim_size ELSE spec2 END) AS same
          FROM layouts GROUP BY 1"""
)
def chunks_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = ch.specs_equal(F.col("spec1"), F.col("spec2"), F.col("dim_size"))
    return layout.all_over_dims(_by_dim(spark, sf_dir), ["dataset"], test, "same")


@query(
    LAY.rstrip()
    + f""", ends AS (SELECT layout_id, least((i + 1) * s, dim_size) AS e
                     FROM (SELECT layout_id, dim_size, s, unnest(range(CAST(ceil(dim_size * 1.0e0 / s) AS BIGINT))) AS i
                           FROM (SELECT layout_id, dim_size, CASE WHEN spec2 = -1 THEN dim_size ELSE spec2 END AS s
                                 FROM layouts WHERE spec2 IS NOT NULL) a) b),
          listed AS (SELECT l.layout_id, bool_and(e = dim_size OR spec1 <> -1 AND e % spec1 = 0) AS ok
                     FROM layouts l JOIN ends ON ends.layout_id = l.layout_id WHERE spec1 IS NOT NULL GROUP BY 1)
         SELECT {SET.replace("layout_id", "l.layout_id")} AS dataset,
                bool_and(CASE WHEN spec1 IS NULL OR spec2 IS NULL OR spec2 = -1 THEN TRUE WHEN spec1 = -1 THEN FALSE
                              ELSE spec1 <= spec2 AND spec2 % spec1 = 0 END) AS mergeable,
                bool_and(coalesce(ok, TRUE)) AS mergeable_lists
         FROM layouts l LEFT JOIN listed ON listed.layout_id = l.layout_id GROUP BY 1"""
)
def rechunk_no_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By number and by the explicit lists the numbers stand for."""
    rows = _by_dim(spark, sf_dir)
    lists = [ch.chunk_sizes(F.col(s), F.col("dim_size")) for s in ("spec1", "spec2")]
    tested = rows.select(
        "dataset",
        ch.no_split(F.col("spec1"), F.col("spec2")).alias("a"),
        F.when(F.col("spec1").isNull() | F.col("spec2").isNull(), True).otherwise(ch.no_split_lists(*lists)).alias("b"),
    )
    return tested.groupBy("dataset").agg(
        F.bool_and("a").alias("mergeable"), F.bool_and("b").alias("mergeable_lists")
    )


ALL_DIMS = "(VALUES ('x'), ('y'), ('z'), ('time')) d(dim)"


@query(
    LAY
    + f"""SELECT s.dataset, d.dim, coalesce(spec1, -1) AS spec
          FROM (SELECT DISTINCT {SET} AS dataset FROM layouts) s CROSS JOIN {ALL_DIMS}
          LEFT JOIN (SELECT {SET} AS dataset, {DIM} AS dim, spec1 FROM layouts) l
                 ON l.dataset = s.dataset AND l.dim = d.dim"""
)
def all_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = _by_dim(spark, sf_dir).select("dataset", "dim", F.col("spec1").alias("spec"))
    return layout.complete_specs(specs, ["dataset"], ["x", "y", "z", "time"])


@query(
    LAY
    + f"""SELECT s.dataset, d.dim, CASE WHEN auto THEN -1 ELSE coalesce(spec1, -1) END AS spec
          FROM (SELECT DISTINCT {SET} AS dataset FROM layouts) s CROSS JOIN (VALUES ('x'), ('y'), ('z')) d(dim)
          LEFT JOIN (SELECT {SET} AS dataset, {DIM} AS dim, spec1, layout_id % 19 = 0 AS auto FROM layouts) l
                 ON l.dataset = s.dataset AND l.dim = d.dim"""
)
def complete_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As for a version to be stored: missing, undecided and automatic sizes become unsplit."""
    text = F.when(F.col("layout_id") % 19 == 0, "auto").otherwise(F.col("spec1").cast("string"))
    specs = _by_dim(spark, sf_dir).select("dataset", "dim", ch.parse_spec(text).alias("spec"))
    return layout.complete_specs(specs, ["dataset"], ["x", "y", "z"])


@query(
    VER
    + """SELECT name, array_to_string(list_filter(want, lambda d: NOT list_contains(have, d)), ',') AS added,
                array_to_string(list_filter(have, lambda d: NOT list_contains(want, d)), ',') AS dropped,
                array_to_string(list_concat(have, list_filter(want, lambda d: NOT list_contains(have, d))), ',') AS merged
         FROM (SELECT name, string_split(dim_order, '') AS have, ['x', 'y', 'time'] AS want FROM versions) v"""
)
def dim_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions to add and to drop to get from each version's order to x, y, time; all dimensions in order."""
    have = scalars.dim_list(F.col("dim_order"))
    want = scalars.string_array(["x", "y", "time"])
    return fx.versions(spark, sf_dir).select(
        "name",
        F.array_join(scalars.dims_to_add(have, want), ",").alias("added"),
        F.array_join(scalars.dims_to_drop(have, want), ",").alias("dropped"),
        F.array_join(scalars.all_dims(have, want), ",").alias("merged"),
    )


# ---------------------------------------------------------------- version catalogue

BELOW = """(v.format = r.format OR r.format IS NULL) AND (v.dim_order = r.dim_order OR r.dim_order IS NULL)
           AND (v.coords = r.coords OR r.coords IS NULL)"""
MERGES = "(v.format <> 'zarr' OR r.chunk_x IS NULL OR (v.chunk_x <= r.chunk_x AND r.chunk_x % v.chunk_x = 0))"


def _count(on: str) -> str:
    return f"""SELECT r.request_id, count(v.name) AS matches, min(v.name) AS first_name
               FROM requests r LEFT JOIN versions v ON {on} GROUP BY r.request_id"""


@query(REQ + _count(f"{BELOW} AND {MERGES}"))
def version_le(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per request, the stored versions at or below it in the version order."""
    out = catalog.versions_below(fx.versions(spark, sf_dir), fx.requests(spark, sf_dir))
    return out.select("request_id", "matches", "first_name")


@query(REQ + _count(BELOW))
def wildcard_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per request, the versions that have all its set attributes."""
    rules = {a: catalog.SAME_IF_SET for a in catalog.ATTRIBUTES}
    out = catalog.count_matches(fx.versions(spark, sf_dir), fx.requests(spark, sf_dir), rules)
    return out.select("request_id", "matches", "first_name")


@query(
    REQ.replace("p_partkey % 5 = 0 AS coords", "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_partkey % 5 = 0 END AS coords")
    + _count(BELOW.replace("r.coords IS NULL", "r.coords IS NULL OR v.coords IS NULL"))
)
def equals_not_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per request, the versions that agree in the attributes set on both sides."""
    versions = fx.versions(spark, sf_dir)
    number = F.substring("name", 2, 20).cast("bigint")
    versions = versions.withColumn("coords", F.when(number % 7 == 0, None).otherwise(F.col("coords")))
    rules = {a: catalog.SAME_OR_UNSET for a in catalog.ATTRIBUTES}
    out = catalog.count_matches(versions, fx.requests(spark, sf_dir), rules)
    return out.select("request_id", "matches", "first_name")


@query(
    REQ
    + f"""SELECT request_id FROM requests r
          WHERE EXISTS (SELECT 1 FROM versions v WHERE {BELOW} AND (v.chunk_x = r.chunk_x OR r.chunk_x IS NULL))"""
)
def has_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.has_version(fx.versions(spark, sf_dir), fx.requests(spark, sf_dir)).select("request_id")


@query(
    REQ.rstrip()
    + f""", cand AS (SELECT r.request_id, v.* FROM requests r JOIN versions v ON {BELOW} AND {MERGES}),
          best AS (SELECT request_id, min(name) AS name FROM cand a
                   WHERE NOT EXISTS (SELECT 1 FROM cand b WHERE b.request_id = a.request_id AND a.format = 'zarr'
                                     AND b.format = 'zarr' AND b.dim_order = a.dim_order AND b.coords = a.coords
                                     AND b.chunk_x > a.chunk_x AND b.chunk_x % a.chunk_x = 0)
                   GROUP BY request_id)
         SELECT r.request_id, coalesce(b.name, 'source') AS name,
                coalesce(r.format, v.format, 'grib') AS format, coalesce(r.dim_order, v.dim_order, 'zyx') AS dim_order,
                coalesce(r.chunk_x, v.chunk_x, -1) AS chunk_x, coalesce(r.coords, v.coords, TRUE) AS coords
         FROM requests r LEFT JOIN best b ON b.request_id = r.request_id LEFT JOIN versions v ON v.name = b.name"""
)
def resolve_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = catalog.resolve_versions(fx.versions(spark, sf_dir), fx.requests(spark, sf_dir), fx.SOURCE)
    return out.select("request_id", "name", "format", "dim_order", "chunk_x", "coords")


@query(
    VER
    + """SELECT name, format, dim_order, chunk_x,
                CASE WHEN CAST(substr(name, 2) AS BIGINT) % 4 = 0 THEN TRUE ELSE coords END AS coords,
                CASE WHEN CAST(substr(name, 2) AS BIGINT) % 4 = 0 THEN '0' ELSE '1' END AS tag FROM versions"""
)
def list_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored catalogue whose older part lacks columns."""
    path = scratch_path(spark, "catalogue")
    rows = fx.versions(spark, sf_dir)
    old = F.substring("name", 2, 20).cast("bigint") % 4 == 0
    rows.filter(old).drop("coords").write.parquet(f"{path}/old")
    rows.filter(~old).withColumn("tag", F.lit("1")).write.parquet(f"{path}/new")
    parts = [spark.read.parquet(f"{path}/new"), spark.read.parquet(f"{path}/old")]
    out = catalog.list_versions(parts, fx.SOURCE)
    return out.select("name", "format", "dim_order", "chunk_x", "coords", "tag")


@query(
    with_views("requests")
    + """SELECT request_id, concat_ws(',', CASE WHEN format IS NULL THEN 'format' END,
                  CASE WHEN dim_order IS NULL THEN 'dim_order' END, CASE WHEN coords IS NULL THEN 'coords' END,
                  CASE WHEN chunk_x IS NULL THEN 'chunk_x' END) AS missing
         FROM requests WHERE format IS NULL OR dim_order IS NULL OR coords IS NULL OR chunk_x IS NULL"""
)
def incomplete_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.requests(spark, sf_dir)
    out = catalog.incomplete_versions(rows, ["format", "dim_order", "coords", "chunk_x"])
    return out.select("request_id", "missing")


# ---------------------------------------------------------------- records


@query(
    REQ
    + """SELECT request_id, coalesce(r.format, v.format, 'grib') AS format,
                coalesce(r.dim_order, v.dim_order, 'zyx') AS dim_order, coalesce(r.chunk_x, v.chunk_x, -1) AS chunk_x,
                coalesce(r.coords, v.coords, TRUE) AS coords, v.name AS name
         FROM requests r LEFT JOIN versions v ON v.name = 'v' || CAST(r.request_id AS VARCHAR)"""
)
def fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open attributes from the version of the same number, then from the source; the name is added."""
    number = F.substring("name", 2, 20).cast("bigint")
    known = fx.versions(spark, sf_dir).withColumn("request_id", number)
    filled = records.fill_from_table(fx.requests(spark, sf_dir), known, ["request_id"])
    return records.fill_from_record(filled, fx.SOURCE)


LEAVES = """, base AS (SELECT p_partkey AS config_id, 'run.workers' AS path, CAST(p_size AS VARCHAR) AS value FROM part
                  UNION ALL SELECT p_partkey, 'run.cluster.cores', p_brand FROM part
                  UNION ALL SELECT p_partkey, 'run.cluster.jobs', p_type FROM part
                  UNION ALL SELECT p_partkey, 'eval', p_name FROM part),
          upd AS (SELECT p_partkey AS config_id, 'run.workers' AS path, 'w' AS value FROM part WHERE p_partkey % 2 = 0
                  UNION ALL SELECT p_partkey, 'run.cluster', 'none' FROM part WHERE p_partkey % 3 = 0
                  UNION ALL SELECT p_partkey, 'eval.main_dim', 'impl' FROM part WHERE p_partkey % 5 = 0)
"""


@query(
    "WITH " + LEAVES.strip().lstrip(",")
    + """, kept AS (SELECT b.* FROM base b WHERE NOT EXISTS
                      (SELECT 1 FROM upd u WHERE u.config_id = b.config_id
                       AND (u.path = b.path OR starts_with(b.path, u.path || '.') OR starts_with(u.path, b.path || '.'))))
         SELECT config_id, path, value FROM kept UNION ALL SELECT config_id, path, value FROM upd"""
)
def config_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = fx.table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "config_id")

    def leaf(path: str, value: F.Column) -> F.Column:
        return F.struct(F.lit(path).alias("path"), value.alias("value"))

    base = part.select(
        "config_id",
        F.inline(
            F.array(
                leaf("run.workers", F.col("p_size").cast("string")),
                leaf("run.cluster.cores", F.col("p_brand")),
                leaf("run.cluster.jobs", F.col("p_type")),
                leaf("eval", F.col("p_name")),
            )
        ),
    )
    updates = part.select(
        "config_id",
        F.inline(
            F.array_compact(
                F.array(
                    F.when(F.col("config_id") % 2 == 0, leaf("run.workers", F.lit("w"))),
                    F.when(F.col("config_id") % 3 == 0, leaf("run.cluster", F.lit("none"))),
                    F.when(F.col("config_id") % 5 == 0, leaf("eval.main_dim", F.lit("impl"))),
                )
            )
        ),
    )
    return records.overlay(base, updates, "config_id")


# ---------------------------------------------------------------- scalar helpers


@query(
    """WITH t AS (SELECT o_orderkey, o_orderkey % 24 AS h, o_orderkey % 60 AS m, (o_orderkey * 7) % 60 AS s,
                         o_orderkey % 9 AS d, o_orderkey % 6 AS f FROM orders)
       SELECT o_orderkey, CAST(CASE f WHEN 0 THEN m * 60 WHEN 1 THEN m * 60 + s WHEN 2 THEN h * 3600 + m * 60 + s
                                 WHEN 3 THEN d * 86400 + h * 3600 WHEN 4 THEN d * 86400 + h * 3600 + m * 60
                                 ELSE d * 86400 + h * 3600 + m * 60 + s END AS BIGINT) AS seconds FROM t"""
)
def slurm_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    h, m, s, d = [c.cast("string") for c in (key % 24, key % 60, key * 7 % 60, key % 9)]
    clock = {0: (m,), 1: (m, s), 2: (h, m, s), 3: (h,), 4: (h, m), 5: (h, m, s)}
    text = F.lit(None).cast("string")
    for form, parts in clock.items():
        written = F.concat_ws(":", *parts)
        if form >= 3:
            written = F.concat(d, F.lit("-"), written)
        text = F.when(key % 6 == form, written).otherwise(text)
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", scalars.slurm_seconds(text).alias("seconds"))


@query("SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS flag FROM lineitem")
def parse_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.table(spark, sf_dir, "lineitem")
    yes = F.when(F.col("l_linenumber") % 2 == 0, "TRUE").otherwise("True")
    text = F.when(F.col("l_returnflag") == "R", yes).otherwise("false")
    return lines.select("l_orderkey", "l_linenumber", scalars.parse_bool(text).alias("flag"))


@query("SELECT p_partkey, 'size=' || CAST(p_size AS VARCHAR) || ',kind=' || p_type AS renamed FROM part")
def map_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = fx.table(spark, sf_dir, "part")
    given = F.create_map(F.lit("s"), F.col("p_size").cast("string"), F.lit("t"), F.col("p_type"))
    renamed = scalars.map_keys(given, scalars.literal_map({"s": "size", "t": "kind"}))
    pairs = F.transform(F.map_entries(renamed), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return part.select("p_partkey", F.array_join(pairs, ",").alias("renamed"))


@query(
    """SELECT p_partkey, CASE WHEN p_brand = p_type THEN p_brand || '=kind' ELSE p_brand || '=brand,' || p_type || '=kind'
              END || CASE WHEN p_name = p_type OR p_name = p_brand THEN '' ELSE ',' || p_name || '=name' END AS swapped
       FROM part"""
)
def map_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = fx.table(spark, sf_dir, "part")
    given = F.create_map(
        F.lit("brand"), F.col("p_brand"), F.lit("kind"), F.col("p_type"), F.lit("name"), F.col("p_name")
    )
    entries = F.map_entries(scalars.map_inverse(given))
    pairs = F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return part.select("p_partkey", F.array_join(pairs, ",").alias("swapped"))


@query(
    """SELECT s_suppkey, s_suppkey AS item FROM supplier UNION ALL SELECT s_suppkey, s_suppkey + 1 FROM supplier
       UNION ALL SELECT s_suppkey, CAST(s_nationkey AS BIGINT) FROM supplier UNION ALL SELECT s_suppkey, -1 FROM supplier"""
)
def flat_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list nested three deep and a scalar, flattened and joined."""
    key, nation = F.col("s_suppkey"), F.col("s_nationkey").cast("bigint")
    nested = F.array(F.array(F.array(key, key + 1)), F.array(F.array(nation)))
    one = scalars.flat_list(F.lit(-1).cast("bigint"), 0)
    items = F.concat(scalars.flat_list(nested, 3), one)
    return fx.table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(items).alias("item"))
