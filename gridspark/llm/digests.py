"""Document fingerprints: quartile digests of hashed byte triplets, and how alike two of them are.

Every byte of a text (UTF-8) starts one triplet for each of ``REACHES``; past its end a text goes on from its start, so short
texts have triplets too. Triplets are hashed into ``BUCKETS`` counters. A counter's code tells the quarter of all counters
that it lies in; codes and the logarithm of the length make the fingerprint, which depends on the text alone. The difference
of two fingerprints adds the differences of codes to that of lengths. It is measured against the sum of the larger codes, its
bound but for the lengths, so that likeness is 1 for equal fingerprints and never below 0.

The next document of every row comes from one range exchange: rows are dealt and sorted by ``doc_id``, every task holds its
previous row only, and the first and last rows of the tasks, two a task, meet in a small second step. Order: nulls first, then
ascending doc_id; rows of one id by the hash of their text; equal rows follow each other and all count. After the last row
comes the first; a single row follows itself. Null texts are empty, empty texts have the digest of no triplets. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.tables import stored

#: Counters of a fingerprint.
BUCKETS = 256
#: Distances of the second and third byte of a triplet from its first.
REACHES = ((3, 7), (4, 9), (5, 11))
#: What a doubling of the length adds to a difference; lengths are kept in 16ths of a doubling.
PER_DOUBLING, STEPS = 5, 16
#: Characters that are digested at once; a longer text is digested alone.
TEXT_CHARS = 1 << 19

_LENGTH_DIGITS = 3
_FACTOR, _SPREAD = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)


def _buckets(data: np.ndarray, reach: int) -> np.ndarray:
    """Bucket of the triplet that starts at each byte but the last ones."""
    second, third = REACHES[reach]
    n = len(data) - max(k for _, k in REACHES)
    x = data[:n] | data[second : n + second] << np.uint32(8) | data[third : n + third] << np.uint32(16)
    x = (x + np.uint32(reach << 24)) * _FACTOR
    x ^= x >> np.uint32(15)
    return x * _SPREAD >> np.uint32(32 - BUCKETS.bit_length() + 1)


def counts(texts: list[bytes]) -> np.ndarray:
    """Triplets of each text by bucket."""
    reach = max(k for _, k in REACHES)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(t + (t * (reach // max(len(t), 1) + 1))[:reach] for t in texts), dtype=np.uint8).astype(np.uint32)
    # An empty text has no bytes at all, any other one its own and those it goes on with.
    held = np.where(sizes > 0, sizes + reach, 0)
    owner = np.repeat(np.arange(len(texts)), held)
    place = np.arange(len(data)) - np.repeat(np.cumsum(held) - held, held)
    own = (place < np.repeat(sizes, held))[: max(len(data) - reach, 0)]
    out = np.zeros(len(texts) * BUCKETS, dtype=np.int64)
    if len(own):
        at = owner[: len(own)][own] * BUCKETS
        for k in range(len(REACHES)):
            out += np.bincount(at + _buckets(data, k)[own], minlength=len(out))
    return out.reshape(-1, BUCKETS)


def codes(counted: np.ndarray) -> np.ndarray:
    """0 to 3: how many of the quartiles of its text a counter exceeds."""
    ranked = np.sort(counted, axis=1)
    quartiles = ranked[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    return (counted[:, :, None] > quartiles[:, None, :]).sum(axis=2).astype(np.uint8)


def fingerprints(texts: list[bytes]) -> list[str]:
    """Length in hexadecimal digits, then four codes a byte."""
    if not texts:
        return []
    found = codes(counts(texts)).reshape(len(texts), -1, 4)
    packed = (found << np.array([6, 4, 2, 0], dtype=np.uint8)).sum(axis=2).astype(np.uint8)
    lengths = [round(STEPS * float(np.log2(len(t) + 1))) for t in texts]
    return [f"{n:0{_LENGTH_DIGITS}x}{row.tobytes().hex()}" for n, row in zip(lengths, packed)]


def _unpacked(prints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([int(p[:_LENGTH_DIGITS], 16) for p in prints])
    packed = np.frombuffer(bytes.fromhex("".join(p[_LENGTH_DIGITS:] for p in prints)), dtype=np.uint8).reshape(len(prints), -1)
    return lengths, (packed[:, :, None] >> np.array([6, 4, 2, 0], dtype=np.uint8) & 3).reshape(len(prints), -1).astype(np.int64)


def likeness(first: list[str], second: list[str]) -> np.ndarray:
    """1 less the bounded difference of fingerprints, pair by pair."""
    if not first:
        return np.zeros(0)
    (n, a), (m, b) = _unpacked(first), _unpacked(second)
    difference = np.abs(a - b).sum(axis=1) + PER_DOUBLING * np.abs(n - m) / STEPS
    return 1 - np.minimum(1, difference / np.maximum(np.maximum(a, b).sum(axis=1), 1))


def with_opening_of(text: str, other: str) -> str:
    """``text`` with its last quarter of code points replaced by as many first ones of ``other``, or all."""
    k = len(text) // 4
    return text[: len(text) - k] + other[:k]


_DIGESTS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [c.split()[0] for c in _DIGESTS.split(", ")]


def _compared(texts: list[str], nexts: list[str], own: list[str], after: list[str]) -> list[pa.Array]:
    """The columns of ``_DIGESTS`` for texts, those that follow, and the fingerprints of both."""
    edited = [with_opening_of(t, n).encode() for t, n in zip(texts, nexts)]
    prints = fingerprints(edited)
    return [
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
        pa.array(own, pa.string()),
        pa.array(prints, pa.string()),
        pa.array(likeness(own, prints), pa.float64()),
        pa.array(likeness(own, after), pa.float64()),
    ]


def _in_chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    a, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > TEXT_CHARS:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a task in order: all but the last are done (kind 0), the first (1) and last (2) also keep their text."""
    task = TaskContext.get().partitionId()
    kind_of_id, last = None, None

    def row_of(kind: int, row: tuple) -> pa.RecordBatch:
        doc_id, text, own = row
        blank = [pa.nulls(1, k) for k in (pa.int64(), pa.string())]
        rest = [pa.nulls(1, pa.string()), pa.nulls(1, pa.float64()), pa.nulls(1, pa.float64())]
        return named([pa.array([kind]), pa.array([task]), pa.array([doc_id], kind_of_id), *blank, pa.array([own]), *rest, pa.array([text])])

    def named(columns: list[pa.Array]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), kind_of_id, None, None, None, None, None, None, pa.string()]
        return pa.RecordBatch.from_arrays([c if k is None else c.cast(k) for c, k in zip(columns, kinds)], names=["kind", "task", "doc_id", *_NAMES, "text"])

    for batch in batches:
        ids = batch.column("doc_id")
        kind_of_id = ids.type
        for a, b in _in_chunks(every := [t or "" for t in batch.column("text").to_pylist()]):
            texts = every[a:b]
            prints = fingerprints([t.encode() for t in texts])
            rows = [*zip(ids[a:b].to_pylist(), texts, prints)]
            if last is None:
                yield row_of(1, rows[0])
            else:
                rows.insert(0, last)
            last = rows.pop()
            if rows:
                follows = [*rows[1:], last]
                done = _compared([r[1] for r in rows], [r[1] for r in follows], [r[2] for r in rows], [r[2] for r in follows])
                n = len(rows)
                yield named([pa.array([0] * n), pa.array([task] * n), pa.array([r[0] for r in rows], kind_of_id), *done, pa.nulls(n, pa.string())])
    if last is not None:
        yield row_of(2, last)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            texts, nexts, own, after = (row.column(c).to_pylist() for c in ("text", "next_text", "fingerprint", "next_fingerprint"))
            yield pa.RecordBatch.from_arrays([row.column("doc_id"), *_compared(texts, nexts, own, after)], names=["doc_id", *_NAMES])


def fingerprinted(documents: DataFrame) -> DataFrame:
    """Per row of ``documents``: its fingerprint, that of the edited text, and the likeness to the edited and to the next."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select("doc_id", text.alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.rand(12).alias("salt"))  # equal rows may be cut apart
    ordered = keyed.repartitionByRange("doc_id", "h", "salt").sortWithinPartitions("doc_id", "h", "salt").select("doc_id", "text")
    followed = stored(ordered.mapInArrow(_follow, f"kind int, task long, doc_id {id_type}, {_DIGESTS}, text string"), "digests")
    first, last = (followed.where(F.col("kind") == k) for k in (1, 2))
    tasks = first.select(F.col("task").alias("now"))
    following = F.lead("now").over(Window.orderBy("now"))
    least = F.min("now").over(Window.partitionBy())
    follows = tasks.select(F.col("now").alias("task"), F.coalesce(following, least).alias("then"))
    heads = first.select(F.col("task").alias("then"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    ends = last.select("doc_id", "text", "fingerprint", "task").join(follows, "task").join(heads, "then")
    met = ends.select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint").mapInArrow(_meet, f"doc_id {id_type}, {_DIGESTS}")
    return followed.where("kind = 0").select("doc_id", *_NAMES).union(met)
