"""Field messages, variable loading, synthetic fields and stored cell tables.

A message table has rows ``(short_name, type_of_level, level, <column keys>, value)``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions.ieee import NAN, not_nan
from gridspark.operators.ranks import highest, with_group_stats

# Names and level types of the diagnostics' inputs.
LAYER_FIELDS = ("P", "T", "QV", "U", "V")
LAYER = "generalVerticalLayer"
HALF_LEVEL = "generalVertical"
INPUT_NAMES = ("P", "T", "QV", "U", "V", "HHL", "HSURF")


def _conjunction(filters: Mapping[str, Any]) -> Column:
    return reduce(Column.__and__, [F.col(k) == v for k, v in filters.items()], F.lit(True))


def scan_field(
    messages: DataFrame,
    short_name: str,
    dims: Sequence[str],
    key_filters: Mapping[str, Any] | None = None,
    coords: Sequence[str] = (),
) -> DataFrame:
    """One variable: the messages whose keys all match. The filters reach the Parquet scan."""
    wanted = {**(key_filters or {}), "short_name": short_name}
    return messages.filter(_conjunction(wanted)).select(*dims, *coords, F.col("value").alias(short_name))


def scan_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Several message files as one table; one scan with one task list."""
    return spark.read.parquet(*paths)


def scan_aligned(spark: SparkSession, paths: Sequence[str], dims: Sequence[str], conflicts: str = "error") -> DataFrame:
    """Files that overlap or lack variables as one table with one row per position; what no file has is NaN.

    Files may hold different variables. Where several files give a position's variable, missing and NaN values yield to
    others. Values that differ are an ``error`` that names two of the files, or the one of the ``first`` or ``last`` file
    by path counts. All files are one scan and one aggregation, combined on the map side.
    """
    if conflicts not in ("error", "first", "last"):
        raise ValueError(f"no rule for conflicts: {conflicts}")
    cells = spark.read.option("mergeSchema", True).parquet(*paths)
    numbers = {c for c, kind in cells.dtypes if kind in ("double", "float")}
    variables = [c for c in cells.columns if c not in dims]
    rows = cells.select(*dims, *variables, F.col("_metadata.file_path").alias("_file"))

    def settled(name: str) -> Column:
        given = not_nan(F.col(name)) if name in numbers else F.col(name)
        at = F.when(given.isNotNull(), F.struct(F.col("_file").alias("file"), given.alias("value")))
        if conflicts != "error":
            chosen = (F.min if conflicts == "first" else F.max)(at)["value"]
        else:
            low, high = F.min(given), F.max(given)
            files = [F.coalesce(f(F.col("_file"), given), F.lit("")) for f in (F.min_by, F.max_by)]
            message = F.concat(F.lit(f"{name} differs between "), files[0], F.lit(" and "), files[1])
            chosen = F.when(low == high, high).when(low != high, F.raise_error(message).cast(cells.schema[name].dataType))
        return (F.coalesce(chosen, F.lit(NAN).cast(cells.schema[name].dataType)) if name in numbers else chosen).alias(name)

    return rows.groupBy(*dims).agg(*map(settled, variables))


def load_fields(
    messages: DataFrame, short_names: Sequence[str], dims: Sequence[str], key_filters: Mapping[str, Any] | None = None
) -> DataFrame:
    """Several variables merged on their dimensions, from one scan and one aggregation; NaN where one is absent."""
    wanted = messages.filter(_conjunction(key_filters or {})).filter(F.col("short_name").isin(list(short_names)))
    return wanted.groupBy(*dims).agg(
        *[F.coalesce(F.max(F.when(F.col("short_name") == n, F.col("value"))), F.lit(NAN)).alias(n) for n in short_names]
    )


def diagnostics_input(messages: DataFrame, keys: Sequence[str], half_levels: DataFrame | None = None) -> DataFrame:
    """Assemble the input of the column diagnostics.

    Layer fields; heights of the half levels (one more than layers) without the last, from ``half_levels`` if they
    are kept apart; the surface height without a level filter; the vertical dimension renamed to ``z``. Positions
    that a variable lacks are NaN.

    All variables are taken from one scan and merged by one aggregation per position; what a whole column decides
    (its last half level, its surface height) is attached to the merged rows.
    """
    keys = list(keys)
    layer = (F.col("type_of_level") == LAYER) & F.col("short_name").isin(list(LAYER_FIELDS))
    half = (F.col("type_of_level") == HALF_LEVEL) & (F.col("short_name") == "HHL")
    ground = F.col("short_name") == "HSURF"
    if half_levels is None:
        wanted = messages.filter(layer | half | ground)
    else:
        wanted = messages.filter(layer).unionByName(half_levels.filter(half | ground))
    merged = wanted.groupBy(*keys, "level").agg(
        *[F.max(F.when(layer & (F.col("short_name") == n), F.col("value"))).alias(n) for n in LAYER_FIELDS],
        F.max(F.when(half, F.col("value"))).alias("HHL"),
        F.max(F.when(ground, F.col("value"))).alias("_ground"),
    )
    column = {
        "_last": highest(F.when(F.col("HHL").isNotNull(), F.col("level"))),
        "HSURF": highest(F.col("_ground")),
    }
    placed = with_group_stats(merged, keys, "level", column)
    volume = [*LAYER_FIELDS, "HHL"]
    cut = placed.withColumn("HHL", F.when(F.col("level") < F.col("_last"), F.col("HHL")))
    cut = cut.filter(F.coalesce(*volume).isNotNull())
    filled = [F.coalesce(n, F.lit(NAN)).alias(n) for n in (*volume, "HSURF")]
    return cut.select(*keys, F.col("level").alias("z"), *filled)


#: Modulus and multiplier of the position hash: a Mersenne prime and one of its primitive roots.
HASH_PRIME = (1 << 31) - 1
HASH_FACTOR = 48271


def uniform(seed: int, *keys: Column) -> Column:
    """Reproducible value in [0, 1) from the position; unlike ``rand`` it does not depend on partitioning.

    Integer arithmetic modulo a prime: each key is added to the state, which is then squared and multiplied.
    """
    state = F.lit(seed % HASH_PRIME).cast("bigint")
    for key in (*keys, F.lit(1), F.lit(2)):
        state = F.pmod(state * HASH_FACTOR + F.pmod(key.cast("bigint"), F.lit(HASH_PRIME)) * 16807 + 12345, F.lit(HASH_PRIME))
        state = F.pmod(state * state + 1, F.lit(HASH_PRIME))
    return state.cast("double") / F.lit(float(HASH_PRIME))


def synthetic_fields(
    positions: DataFrame, dims: Sequence[str], names: Sequence[str] = INPUT_NAMES, seed: int = 0, step: float = 0.1
) -> DataFrame:
    """One random field; variable ``k`` is that field plus ``k * step``, the last one its value at ``z = 0``."""
    *volume, flat = names
    value = uniform(seed, *[F.col(d) for d in dims])
    ground = uniform(seed, *[F.lit(0).cast("bigint") if d == "z" else F.col(d) for d in dims])
    return positions.select(*dims, value.alias("_r"), ground.alias("_g")).select(
        *dims,
        *[(F.col("_r") + F.lit(i * step)).alias(n) for i, n in enumerate(volume)],
        (F.col("_g") + F.lit(len(volume) * step)).alias(flat),
    )


def index_grid(spark: SparkSession, shape: Mapping[str, int]) -> DataFrame:
    """All positions of a grid, the last dimension varying fastest; generated in parallel."""
    total = reduce(lambda a, b: a * b, shape.values(), 1)
    index, columns, stride = F.col("id"), [], total
    for d, n in shape.items():
        stride //= n
        columns.append((F.floor(index / F.lit(stride)) % n).cast("bigint").alias(d))
    return spark.range(total).select(*columns)


# ---------------------------------------------------------------- stored versions


def write_cells(cells: DataFrame, path: str) -> None:
    """Unpartitioned, overwriting."""
    cells.write.mode("overwrite").parquet(path)


def write_chunked(cells: DataFrame, path: str, chunk_columns: Sequence[str]) -> None:
    """One directory per chunk, so that a chunk predicate prunes directories.

    ``rebalance`` gathers a chunk's cells into few files and splits chunks that are too large for one task.
    """
    placed = cells.hint("rebalance", *chunk_columns)
    placed.write.mode("overwrite").partitionBy(*chunk_columns).parquet(path)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_placed(cells: DataFrame, name: str, path: str, chunk_columns: Sequence[str], dims: Sequence[str], buckets: int) -> None:
    """Store cells as the table ``name`` that remembers where its chunks are: by chunk in ``buckets`` sorted files.

    Tables with equal chunks and as many buckets join and aggregate by chunk without moving a cell, in a session of
    ``placed_session``. A chunk stays in one task, so cut deep columns into chunks as well.
    """
    placed = cells.repartition(buckets, *chunk_columns).write.mode("overwrite").option("path", path)
    placed.bucketBy(buckets, *chunk_columns).sortBy(*chunk_columns, *dims).format("parquet").saveAsTable(name)


def placed_session(spark: SparkSession) -> SparkSession:
    """A session on the same cluster and tables in which joins by chunk and position accept tables placed by chunk.

    By default a join moves both sides unless they are placed by all of its keys.
    """
    own = spark.newSession()
    for setting in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        value = spark.conf.get(setting, None)
        if value is not None:
            own.conf.set(setting, value)
    own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return own


def discard(df: DataFrame) -> None:
    """Compute everything and keep nothing."""
    df.write.format("noop").mode("overwrite").save()
