"""Exact top-k inner products with a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it. Vectors of a pivot within a range of distances form an
annulus; an annulus is stored as blocks of bounded size. For a query q, a pivot p and an annulus of distances [lo, hi] the
triangle inequality gives |q - x| >= max(lo - |q - p|, |q - p| - hi, 0) for every x in it, hence an upper bound of q.x by
(|q|^2 + |x|^2 - |q - x|^2) / 2 <= q.x; another one is q.p + |q| hi. Annuli are taken by falling bound: the first ones
give each query its k-th best score so far, and of the others only those whose bound reaches it are read.

The pivots are fitted on a bounded sample, which also gives a first k-th score. The directory of annuli has at most
``PIVOTS * RINGS`` rows whatever the size of the table, so it may be broadcast. Queries travel in blocks too; a hot annulus
is many blocks, which the join on annuli spreads.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridspark.llm import sampling
from gridspark.llm.tables import stored

#: Rows that pivots and rings are fitted on, at most.
SAMPLE_ROWS = 4_096
PIVOTS = 32
RINGS = 8
#: Vectors of a block, and queries of a query block, at most.
BLOCK_ROWS = 512
#: Vectors that a query reads in its first annuli, about.
FIRST_ROWS = 2_048
#: Bounds are computed in floating point; this relative margin keeps them safe.
_MARGIN = 1e-9

RESULT = "query_id bigint, rank int, vec_id bigint, score bigint"


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id`` and ``v``, the floor of ``scale`` times each component as longs.

    Rows of a null id, a null vector, or null or non-finite components are left out.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & finite).select(
        "vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v")
    )


def _matrix(lists: pa.Array, dimensions: int) -> np.ndarray:
    """Rows of longs, filled up with zeros to ``dimensions``."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.diff(np.asarray(lists.offsets))
    flat = np.asarray(lists.flatten(), dtype=np.int64)
    if (sizes == dimensions).all():
        return flat.reshape(len(sizes), dimensions)
    out = np.zeros((len(sizes), dimensions), dtype=np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of rows as longs; by floating point where that is exact."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), dtype=np.int64)
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def best(scores: np.ndarray, queries: np.ndarray, ids: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(row of the query, id, score) of the ``k`` best ids of each query that reach its ``least`` score.

    Several vectors of one id count as one with the highest score; the query's own id takes no part.
    """
    q, x = np.nonzero((scores >= least[:, None]) & (queries[:, None] != ids[None, :]))
    score, found = scores[q, x], ids[x]
    order = np.lexsort((-score, found, q))
    q, found, score = q[order], found[order], score[order]
    first = np.concatenate(([True], (q[1:] != q[:-1]) | (found[1:] != found[:-1]))) if len(q) else np.zeros(0, dtype=bool)
    q, found, score = q[first], found[first], score[first]
    order = np.lexsort((found, -score, q))
    q, found, score = q[order], found[order], score[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    top = place < k
    return q[top], found[top], score[top]


@dataclass
class Pivots:
    centres: np.ndarray
    width: np.ndarray  # of the rings of each pivot
    sample_ids: np.ndarray
    sample: np.ndarray

    @classmethod
    def fit(cls, ids: np.ndarray, x: np.ndarray, pivots: int = PIVOTS, rings: int = RINGS, rounds: int = 8) -> Pivots:
        random = np.random.default_rng(3)
        points = x.astype(float)
        centres = points[random.permutation(len(points))[:pivots]]
        for _ in range(rounds):
            near = _distances(points, centres).argmin(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, points)
            count = np.bincount(near, minlength=len(centres))
            centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
        d = _distances(points, centres)
        near = d.argmin(axis=1)
        reach = np.zeros(len(centres))
        np.maximum.at(reach, near, d[np.arange(len(points)), near])
        return cls(centres, np.maximum(reach / rings, 1e-9), ids, x)

    def keys(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pivot, ring and distance of each row."""
        d = _distances(x.astype(float), self.centres)
        near = d.argmin(axis=1)
        own = d[np.arange(len(x)), near]
        return near, np.minimum(own / self.width[near], RINGS - 1).astype(np.int32), own


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squared = (x**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None, :] - 2 * (x @ centres.T)
    return np.sqrt(np.maximum(squared, 0))


@dataclass
class Directory:
    """The annuli: pivot, ring, range of distances, largest norm and number of rows of each."""

    pivot: np.ndarray
    ring: np.ndarray
    low: np.ndarray
    high: np.ndarray
    norm: np.ndarray
    rows: np.ndarray

    def bounds(self, x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        """Upper bound of the inner product of each row with any vector of each annulus."""
        x = x.astype(float)
        norm = np.sqrt((x**2).sum(axis=1))
        d = _distances(x, centres)[:, self.pivot]
        gap = np.maximum(np.maximum(self.low[None, :] - d, d - self.high[None, :]), 0)
        slack = 1e-6 * (1 + d)  # distances by differences of squares lose some digits
        by_distance = (norm[:, None] ** 2 + self.norm[None, :] ** 2 - np.maximum(gap - slack, 0) ** 2) / 2
        by_centre = (x @ centres.T)[:, self.pivot] + norm[:, None] * self.high[None, :]
        bound = np.minimum(by_distance, by_centre)
        return bound + _MARGIN * (np.abs(bound) + norm[:, None] * self.norm[None, :]) + 1e-3

    def first(self, bound: np.ndarray) -> np.ndarray:
        """Mask of the annuli that each query reads first: by falling bound, until ``FIRST_ROWS`` rows."""
        order = np.argsort(-bound, axis=1, kind="stable")
        before = np.cumsum(self.rows[order], axis=1) - self.rows[order]
        mask = np.zeros(bound.shape, dtype=bool)
        np.put_along_axis(mask, order, before < FIRST_ROWS, axis=1)
        return mask


def _index(vectors: DataFrame, pivots: Pivots, dimensions: int) -> DataFrame:
    """Blocks of vectors, each within one annulus, in the order of pivot, ring, distance and id."""
    held = vectors.sparkSession.sparkContext.broadcast(pivots)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch["v"], dimensions)
            pivot, ring, distance = held.value.keys(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pivot, pa.int32()), pa.array(ring, pa.int32()), pa.array(distance), batch["vec_id"],
                 pa.array([row.tobytes() for row in x], pa.binary())],
                names=["pivot", "ring", "distance", "vec_id", "v"],
            )

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot, ring, distance = (np.asarray(batch[c]) for c in ("pivot", "ring", "distance"))
            ids, v = np.asarray(batch["vec_id"]), batch["v"].to_pylist()
            cuts = np.flatnonzero((np.diff(pivot) != 0) | (np.diff(ring) != 0)) + 1
            rows = []
            for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                for s in range(a, b, BLOCK_ROWS):
                    e = min(b, s + BLOCK_ROWS)
                    raw = b"".join(v[s:e])
                    x = np.frombuffer(raw, dtype=np.int64).reshape(e - s, -1).astype(float)
                    rows.append((int(pivot[s]), int(ring[s]), float(distance[s]), float(distance[e - 1]),
                                 float(np.sqrt((x**2).sum(axis=1).max())), e - s, ids[s:e].tobytes(), raw))
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["pivot", "ring", "low", "high", "norm", "n", "ids", "x"],
            )

    rows = vectors.mapInArrow(keyed, "pivot int, ring int, distance double, vec_id bigint, v binary")
    # the id splits a distance that very many vectors share
    ordered = rows.repartitionByRange("pivot", "ring", "distance", "vec_id").sortWithinPartitions(
        "pivot", "ring", "distance", "vec_id"
    )
    made = ordered.mapInArrow(
        blocked, "pivot int, ring int, low double, high double, norm double, n bigint, ids binary, x binary"
    )
    return stored(made, "topk-index")


def _visits(queries: DataFrame, pivots: Pivots, directory: Directory, dimensions: int, rest: bool) -> DataFrame:
    """Rows (pivot, ring, ids, vectors and least scores of a block of queries) of the annuli that the queries read:
    the first ones, or the rest that can still hold a better score."""
    held = queries.sparkSession.sparkContext.broadcast((pivots, directory))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cells = held.value
        for batch in batches:
            for s in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(s, BLOCK_ROWS)
                ids, x = np.asarray(part["vec_id"]), _matrix(part["v"], dimensions)
                least = np.asarray(part["least"])
                bound = cells.bounds(x, own.centres)
                first = cells.first(bound)
                wanted = (~first if rest else first) & (bound >= least[:, None])
                rows = [
                    (int(cells.pivot[c]), int(cells.ring[c]), ids[m].tobytes(), x[m].tobytes(), least[m].tobytes())
                    for c in range(wanted.shape[1])
                    if (m := wanted[:, c]).any()
                ]
                if rows:
                    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                        names=["pivot", "ring", "q_ids", "q", "least"],
                    )

    return queries.mapInArrow(visits, "pivot int, ring int, q_ids binary, q binary, least binary")


def _scored(visits: DataFrame, index: DataFrame, k: int, dimensions: int) -> DataFrame:
    """(query_id, vec_id, score) of the best of each pair of a query block and a block of its annulus."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q, least, ids, x in zip(*(batch[c] for c in ("q_ids", "q", "least", "ids", "x")), strict=True):
                own = np.frombuffer(q_ids.as_py(), dtype=np.int64)
                ids_ = np.frombuffer(ids.as_py(), dtype=np.int64)
                a = np.frombuffer(q.as_py(), dtype=np.int64).reshape(len(own), dimensions)
                b = np.frombuffer(x.as_py(), dtype=np.int64).reshape(len(ids_), dimensions)
                row, found, score = best(products(a, b), own, ids_, np.frombuffer(least.as_py(), dtype=np.int64), k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[row]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"]
                )

    pairs = visits.join(index.select("pivot", "ring", "ids", "x"), ["pivot", "ring"])
    return pairs.select("q_ids", "q", "least", "ids", "x").mapInArrow(scored, "query_id bigint, vec_id bigint, score bigint")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    distinct = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return distinct.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, k: int = 5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The ``k`` highest inner products of every query among all other ids: ``query_id``, ``rank``, ``vec_id``, ``score``.

    ``vectors`` has ``vec_id`` and ``v`` (array of longs, see ``quantised``); ``is_query`` picks the queries by their id.
    Ties go to the smaller id. Rows that share an id count as one item, scored by the best pair of their vectors. Vectors
    of different lengths are compared as if the shorter ended in zeros. Scores have to fit a long.
    """
    spark = vectors.sparkSession
    rows = stored(vectors.select("vec_id", "v"), "topk-vectors")
    dimensions = rows.agg(F.max(F.size("v"))).first()[0]
    if dimensions is None:
        return spark.createDataFrame([], RESULT)
    if dimensions == 0:
        rows, dimensions = rows.withColumn("v", F.array(F.lit(0).cast("long"))), 1
    picked = sampling.bounded(rows, sample_rows, "vec_id").toArrow()
    pivots = Pivots.fit(np.asarray(picked["vec_id"].combine_chunks()), _matrix(picked["v"], dimensions))
    index = _index(rows, pivots, dimensions)
    cells = index.groupBy("pivot", "ring").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.max("norm").alias("norm"), F.sum("n").alias("n")
    )
    listed = sorted(cells.collect())  # at most PIVOTS * RINGS rows
    directory = Directory(*(np.array(c) for c in zip(*listed, strict=True)))
    held = spark.sparkContext.broadcast(pivots)

    def started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with the k-th best score among the sample, or the least long if that has fewer ids."""
        own = held.value
        for batch in batches:
            for s in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(s, BLOCK_ROWS)
                ids, x = np.asarray(part["vec_id"]), _matrix(part["v"], dimensions)
                least = np.full(len(ids), np.iinfo(np.int64).min)
                row, _, score = best(products(x, own.sample), ids, own.sample_ids, least, k)
                full = np.bincount(row, minlength=len(ids)) == k
                lowest = np.full(len(ids), np.iinfo(np.int64).max)
                np.minimum.at(lowest, row, score)
                yield pa.RecordBatch.from_arrays(
                    [part["vec_id"], part["v"], pa.array(np.where(full, lowest, least))], names=["vec_id", "v", "least"]
                )

    queries = rows.where(is_query).mapInArrow(started, "vec_id bigint, v array<bigint>, least bigint")
    queries = stored(queries, "topk-queries")
    near = stored(_scored(_visits(queries, pivots, directory, dimensions, False), index, k, dimensions), "topk-near")
    reached = _ranked(near, k).where(F.col("rank") == k).select(F.col("query_id").alias("of"), F.col("score").alias("reached"))
    raised = queries.join(reached, queries["vec_id"] == reached["of"], "left").select(
        "vec_id", "v", F.greatest("least", F.coalesce("reached", "least")).alias("least")
    )
    far = _scored(_visits(raised, pivots, directory, dimensions, True), index, k, dimensions)
    return _ranked(near.unionByName(far), k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )


#: The same as SQL, for queries whose id is divisible by 50 and the five best.
SEARCH_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id, CAST(list_dot_product(q.x, v.x) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""
