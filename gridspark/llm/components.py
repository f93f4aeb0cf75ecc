"""Connected components by alternating large and small stars, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.tables import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang the larger neighbours of every node below its least neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy(F.col("u").alias("of")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
    hung = both.where("v > u").join(least, F.col("u") == F.col("of")).select(F.col("m").alias("a"), F.col("v").alias("b"))
    return hung.where("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang every node and its smaller neighbours below the least of them."""
    least = edges.groupBy(F.col("b").alias("of")).agg(F.min("a").alias("m"))
    joined = edges.join(least, F.col("b") == F.col("of"))
    smaller = joined.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return smaller.union(least.select("m", "of")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node reachable) of every node that ``links`` (``a`` < ``b``) names.

    Both stars group by node with map-side combine; rounds are written to the shared folder and their number grows with
    the logarithm of the longest chain.
    """
    edges = stored(links.select("a", "b").distinct(), "links")
    before = _state(edges)
    while before[0]:
        edges = stored(_small_star(_large_star(edges)), "stars")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        edges.select(F.col("a"), F.col("a")).distinct()
    )
