"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against every window of training words.

A window is ``width`` consecutive words of an item; an item of fewer words, but not none, is one window. Hash hits are
verified word by word. The benchmark is read in blocks of bounded size, each broadcast and scanned on its own, one after
the other: hits of a block are stored and its broadcast is destroyed before the next, so neither broadcasts nor plan grow
with the benchmark. Usually one block holds all of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.tables import stored
from gridspark.llm.text import ALPHANUMERIC, Piece, grams, pieces

#: Words of a window.
WIDTH = 10
#: Bytes of benchmark text in a broadcast block, about; an index takes some 30 times as much.
BLOCK_BYTES = 4 << 20

_HITS = "struct<n_words:bigint,spans:array<struct<a:int,b:int>>,items:array<string>>"


@dataclass
class Windows:
    """The windows of a block: by width the sorted hashes, and for each window its items."""

    hashes: dict[int, np.ndarray]
    items: dict[bytes, tuple[str, ...]]

    @classmethod
    def of(cls, rows: list[tuple[str, str]], width: int) -> Windows:
        hashes: dict[int, list[np.ndarray]] = {}
        items: dict[bytes, set[str]] = {}
        names = [name for name, _ in rows]
        for piece in pieces(pa.array([text for _, text in rows], pa.string())):
            starts, ends, first = piece.spans(ALPHANUMERIC)
            words = piece.hashes(starts, ends)
            for i in range(piece.n):
                a, b = int(first[i]), int(first[i + 1])
                if a == b:
                    continue
                w = min(width, b - a)
                hashes.setdefault(w, []).append(grams(words[a:b], w))
                for j in range(a, b - w + 1):
                    items.setdefault(_window(piece, starts, ends, j, w), set()).add(names[piece.first + i])
        return cls({w: np.unique(np.concatenate(h)) for w, h in hashes.items()}, {k: tuple(v) for k, v in items.items()})


def _window(piece: Piece, starts: np.ndarray, ends: np.ndarray, at: int, width: int) -> bytes:
    return b" ".join(piece.lower[starts[j] : ends[j]].tobytes() for j in range(at, at + width))


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Positions of ``values`` that occur in the sorted ``table``; a bitmap of the high bits passes most others by."""
    bitmap = np.zeros(1 << 20, dtype=bool)
    bitmap[(table >> np.uint64(44)).astype(np.int64)] = True
    maybe = np.flatnonzero(bitmap[(values >> np.uint64(44)).astype(np.int64)])
    found = np.searchsorted(table, values[maybe])
    return maybe[table[np.minimum(found, len(table) - 1)] == values[maybe]]


def _scan(piece: Piece, windows: Windows, hit: list[list[tuple[int, int]]], items: list[set[str]]) -> np.ndarray:
    starts, ends, first = piece.spans(ALPHANUMERIC)
    words = piece.hashes(starts, ends)
    for width, table in windows.hashes.items():
        for at in _member(grams(words, width), table):
            i = int(np.searchsorted(first, at, side="right")) - 1
            if at + width > first[i + 1]:
                continue
            names = windows.items.get(_window(piece, starts, ends, at, width))
            if names is not None:
                hit[i].append((int(at - first[i]), int(at - first[i] + width)))
                items[i].update(names)
    return np.diff(first)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _hits(held: Broadcast, text: Column, before: Column | None) -> Column:
    """Struct of the number of words, the merged spans of hit words and the items, added to what ``before`` holds."""

    @F.arrow_udf(_HITS)
    def scanned(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        windows = held.value
        for texts, *earlier in batches:
            old = earlier[0].to_pylist() if earlier else [None] * len(texts)
            out = []
            for piece in pieces(texts):
                own = old[piece.first : piece.first + piece.n]
                hit = [[(s["a"], s["b"]) for s in o["spans"]] if o else [] for o in own]
                items = [set(o["items"]) if o else set() for o in own]
                sizes = _scan(piece, windows, hit, items)
                out += [
                    {"n_words": int(n), "spans": [{"a": a, "b": b} for a, b in _merged(h)], "items": sorted(s)}
                    for n, h, s in zip(sizes, hit, items, strict=True)
                ]
            yield pa.array(out, pa.struct([
                ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
                ("items", pa.list_(pa.string())),
            ]))

    return scanned(text, before) if before is not None else scanned(text, F.lit(None).cast(_HITS))


def hits(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``documents`` with a struct column ``__hits``: ``n_words``, ``spans`` of hit words (end exclusive) and ``items``.

    Null texts have no words. Items are named by their ids as strings; a null id is the empty string, and rows of one
    id are one item. An empty benchmark hits nothing.

    Hits depend on the text alone, so those of all blocks but the last are stored once per text, named by its SHA-256, and
    joined to the documents, which the last block adds its own to. Without earlier blocks nothing is stored or joined.
    """
    spark = documents.sparkSession
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text")
    ).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // block_bytes + 1

    def broadcast(block: int) -> Broadcast:
        rows = items.where(F.pmod(F.xxhash64("text", "item"), F.lit(blocks)) == block).collect()
        return spark.sparkContext.broadcast(Windows.of([(r.item, r.text) for r in rows], width))

    key = F.sha2(F.col("text"), 256)
    earlier: list[DataFrame] = []
    for block in range(blocks - 1):
        held = broadcast(block)
        found = documents.select(key.alias("__hits_text"), _hits(held, F.col("text"), None).alias("own"))
        earlier.append(stored(found.where(F.size("own.spans") > 0).dropDuplicates(["__hits_text"]), "hits"))
        held.destroy()
    if not earlier:
        return documents.withColumn("__hits", _hits(broadcast(0), F.col("text"), None))
    before = reduce(DataFrame.union, earlier).groupBy("__hits_text").agg(
        F.struct(
            F.lit(0).cast("long").alias("n_words"),
            F.flatten(F.collect_list("own.spans")).alias("spans"),  # one row a block at most
            F.flatten(F.collect_list("own.items")).alias("items"),
        ).alias("__hits_before")
    )
    known = documents.join(before, key == F.col("__hits_text"), "left")
    last = _hits(broadcast(blocks - 1), F.col("text"), F.col("__hits_before"))
    return known.withColumn("__hits", last).drop("__hits_text", "__hits_before")


def _n_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + (s["b"] - s["a"]).cast("long"))


def contamination(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """For every row: ``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated``."""
    found = hits(documents.select("doc_id", "text"), benchmark, width).select("doc_id", "__hits")
    return found.select(
        "doc_id",
        F.col("__hits.n_words").alias("n_words"),
        _n_hit(F.col("__hits.spans")).alias("n_hit"),
        F.size("__hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__hits.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("__hits.spans") > 0).alias("contaminated"),
    )


def without_contaminated(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents that hold no benchmark window, with all their columns."""
    return hits(documents, benchmark, width).where(F.size("__hits.spans") == 0).drop("__hits")


def without_spans(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """All documents, hit words and what stands between them cut out of ``text``; a cut leaves one blank."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out: list[str | None] = []
        hit, present = spans.to_pylist(), texts.is_valid().to_pylist()
        for piece in pieces(texts):
            starts, ends, first = piece.spans(ALPHANUMERIC)
            for i in range(piece.n):
                own, at, parts = hit[piece.first + i], piece.offsets[i], []
                for s in own:
                    parts.append(piece.data[at : starts[first[i] + s["a"]]].tobytes())
                    at = ends[first[i] + s["b"] - 1]
                parts.append(piece.data[at : piece.offsets[i + 1]].tobytes())
                out.append(b" ".join(parts).decode() if present[piece.first + i] else None)
        return pa.array(out, pa.string())

    return hits(documents, benchmark, width).withColumn("text", cut("text", F.col("__hits.spans"))).drop("__hits")


#: The same as SQL.
CONTAMINATION_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, w[i : i + least(len(w), 10) - 1] AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (
  SELECT r, n, i, w[i : i + n - 1] AS g
  FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT r, pos.n, i, item FROM pos JOIN win ON pos.n = win.n AND pos.g = win.g),
words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hit) GROUP BY r),
items AS (SELECT r, list_sort(list(DISTINCT item)) AS names FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(names), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(names, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
