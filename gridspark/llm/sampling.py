"""Held-out folds and bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True if crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def bounded(rows: DataFrame, limit: int, key: str) -> DataFrame:
    """At most ``limit`` rows, those with the least hash of ``key``: the same on every run, independent of order."""
    return rows.orderBy(F.xxhash64(F.lit(17), F.col(key)), F.col(key)).limit(limit)
