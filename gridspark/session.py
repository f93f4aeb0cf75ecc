"""Session set-up for tests and benchmarks, and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Single-machine session for tests and ``bench.py``; on a cluster use the session it provides."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gridspark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/intermediate")
    return spark


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path for an intermediate table, in the folder that ``spark.checkpoint.dir`` names.

    All executors must see the folder, so none is made up.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


@contextmanager
def shuffle_files_removed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of an action go with its end; else they would stay until the driver happens to collect its
    garbage."""
    before = spark.conf.getAll.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)


def store(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write ``df`` as Parquet and leave no shuffle files."""
    with shuffle_files_removed(df.sparkSession):
        df.write.mode(mode).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: stable values, short lineage."""
    path = scratch_path(df.sparkSession, tag)
    store(df, path, "overwrite")
    return df.sparkSession.read.parquet(path)
