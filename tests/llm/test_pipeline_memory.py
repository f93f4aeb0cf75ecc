"""What the stages of the pipeline leave in the executors: size of Arrow batches, shuffle files."""

import os
import time

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridspark.llm import tables

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@pytest.fixture
def own(spark):
    """A session with settings of its own."""
    return spark.newSession()


def largest_batch(docs):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes]})

    return docs.mapInArrow(sizes, "bytes long").agg(F.max("bytes")).first()[0]


@pytest.mark.parametrize("asked", [None, "64k"])
def test_stages_hand_texts_over_in_small_batches(own, asked):
    if asked:
        own.conf.set(BATCH, asked)
    docs = own.range(0, 8_000, 1, 1).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("ab cd "), 400).alias("text"), F.lit("en").alias("lang"),
        F.lit("s").alias("source"), F.lit(2_400).cast("long").alias("n_chars"),
    )
    assert largest_batch(docs) > tables.BATCH_BYTES * 2 or asked
    stages = dict(corpus_pipeline.STAGES)
    assert stages["decontamination"](own, docs, "/root/testdata/sf0.001").count() == 8_000
    assert largest_batch(docs) < (100_000 if asked else tables.BATCH_BYTES * 1.2)
    assert own.conf.get(BATCH) == (asked or str(tables.BATCH_BYTES))


def shuffle_files(spark):
    folders = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()
    return {f for top in folders for _, _, names in os.walk(str(top)) for f in names if f.startswith("shuffle_")}


@pytest.mark.parametrize("asked", [None, "false", "true"])
def test_stored_leaves_no_shuffle_files(own, asked):
    if asked:
        own.conf.set(CLEAN, asked)
    before = shuffle_files(own)
    kept = tables.stored(own.range(10_000).groupBy((F.col("id") % 100).alias("k")).count(), "kept")
    until = time.time() + 10
    while shuffle_files(own) - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffle_files(own) - before
    assert own.conf.getAll.get(CLEAN) == asked
    assert kept.agg(F.sum("count")).first()[0] == 10_000
