"""Reading the given tables and keeping intermediate ones in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch that goes to Python, about. Spark's own bounds (10,000 rows, 64 MB) let a batch of texts take some
#: 25 MB, which an executor holds several times for each task: as queued rows, as Arrow buffers and in the Python worker.
BATCH_BYTES = 4 << 20

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the folder that ``spark.checkpoint.dir`` names, which driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/llm-{tag}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of the session have about ``BATCH_BYTES``, unless it sets a bound of its own."""
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, safe from lost executors, short lineage.

    The shuffle files of the write go with its end; else they would stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = shared_path(spark, tag)
    before = spark.conf.getAll.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)
