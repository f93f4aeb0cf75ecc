"""N-gram Jaccard join by parity sketches, for the connected components of similar documents.

A document is the set of its distinct shingle hashes. Its sketch of P words XORs every hash into one word by position.
An element that only one of two sets has changes one word, so the number of differing words is a lower bound of the
symmetric difference D, and at least P - D words agree. Sets of Jaccard similarity t have D <= (1 - t) / (1 + t) *
(|A| + |B|); sizes are cut into bands, each with the number of words that its largest pairs need, and a set whose partners
may lie in the band below makes a sketch for that too. So by the pigeonhole two similar sets agree in a word.

* Every sketch word is counted over all sets. Words sorted by that count, words that one set has alone come first, and two
  similar sets share one of their first T + 1 words, T being the largest D that a set's partners allow. That keeps
  passages that very many documents share from pairing them, and drops sets with T + 1 words of their own at once.
* The words travel as packed arrays, cut by hash into buckets that grow with the shuffle partitions. A word that very many
  sets of a task share is sent once with its count, and its sets take a way of their own, spread by set.
* The sets that share a word are first compared with one of them. Components of these links are formed. In further rounds
  the sets of a word that are outside its largest component are compared with members of that component, one row each, for
  as long as that links more. Then sets that share a word but are still in different components are compared. Equal sets are
  one set throughout. No link between sets of different components is left out, so the components are exact, without
  pairing all members of a group of copies.
* Pairs are first held against bit sketches (parity of the hashes at each bit), then against the sets.

Hashes have 64 bits: a shingle counts as equal if its hash is, a set if size and 64-bit hash are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridspark.llm.components import components
from gridspark.llm.tables import stored
from gridspark.llm.text import SHINGLE, mix, pieces, shingle_sets

#: Two documents link if 100 * |intersection| >= SIMILARITY * |union|.
SIMILARITY = 80
#: Largest size of a band over its smallest, and words of a sketch over the least number that the pigeonhole needs.
BAND = 1.7
SLACK = 1.2
#: Sketch words that a task gathers before it sends them, about, and sets of one task from which a shared word is sent once.
GATHERED = 1 << 18
SHARED = 64
#: Parts, by hash, in which a task sorts its words; a power of two.
RANGES = 16
#: Sets of a block that are compared with another block at once, about.
BLOCK_SETS = 256
#: Sets of a word that are paired by their ids, at most; those of other words meet in blocks, with their bit sketches.
FEW = 16
#: Rounds in which sets are compared with members of the largest component of their words, at most.
ROUNDS = 4
#: Bits of the filter of wanted sets or rows: 16 for each, at most this many.
FILTER_BITS = 1 << 26

_MAPPED = (
    "kind int, bucket long, doc_id long, sid long, n long, need0 int, need1 int, "
    "words binary, sids binary, shared binary, counts binary"
)
_REDUCED = "kind int, doc_id long, sid long, n long, need0 int, need1 int, word long, cnt long"
_DOCUMENT, _ENTRY, _MEMBER, _SHARED = range(4)


@dataclass(frozen=True)
class Bands:
    """For each band: smallest and largest size, largest size of a partner, and words of the sketch (0: no pairs)."""

    low: np.ndarray
    high: np.ndarray
    top: np.ndarray
    words: np.ndarray
    similarity: int

    @classmethod
    def of(cls, similarity: int = SIMILARITY, largest: int = 1 << 40) -> Bands:
        low = [1]
        while low[-1] <= largest:
            low.append(max(low[-1] + 1, int(low[-1] * BAND)))
        high = np.array(low[1:], dtype=np.int64) - 1
        top = high * 100 // similarity
        most = (high + top) * (100 - similarity) // (100 + similarity)
        words = np.where(most > 0, np.ceil(SLACK * (most + 1)).astype(np.int64), 0)
        return cls(np.array(low[:-1], dtype=np.int64), high, top, words, similarity)

    def most(self, n: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Largest symmetric difference between a set of ``n`` and a similar one in this band."""
        partner = np.where(n <= self.high[band], np.minimum(n * 100 // self.similarity, self.top[band]), self.high[band])
        return (n + partner) * (100 - self.similarity) // (100 + self.similarity)


def set_id(shingles: np.ndarray) -> int:
    """Signed 64-bit id of a set from its hashes and size."""
    total = mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(mix(np.array([total], dtype=np.uint64)).view(np.int64)[0])


def sketch_words(sets: list[np.ndarray], band: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the set, word, number of words) of the sketches of ``sets`` in their ``band``.

    The lowest bit of a word tells an empty position (they sort last), the next one the parity of the band. Empty
    positions are words too, but are given only for sets that have too few others.
    """
    n = np.array([len(s) for s in sets], dtype=np.int64)
    size = bands.words[band]
    offset = np.concatenate(([0], np.cumsum(size)))
    owner = np.repeat(np.arange(len(sets)), n)
    hashes = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    spread = mix(hashes + band.astype(np.uint64)[owner] * np.uint64(0x9E3779B97F4A7C15))
    position = ((spread >> np.uint64(32)) * size.astype(np.uint64)[owner] >> np.uint64(32)).astype(np.int64) + offset[owner]
    order = np.argsort(position, kind="stable")
    position, hashes = position[order], hashes[order]
    first = np.flatnonzero(np.concatenate(([True], position[1:] != position[:-1]))) if len(position) else np.zeros(0, int)
    value = np.zeros(int(offset[-1]), dtype=np.uint64)
    filled = np.zeros(int(offset[-1]), dtype=bool)
    if len(first):
        value[position[first]] = np.bitwise_xor.reduceat(hashes, first)
        filled[position[first]] = True
    of = np.repeat(np.arange(len(sets)), size)
    place = (np.arange(len(of)) - offset[of]).astype(np.uint64) + (band.astype(np.uint64)[of] << np.uint64(40))
    word = mix(value ^ mix(place)) & ~np.uint64(3)
    word |= (band.astype(np.uint64)[of] & np.uint64(1)) << np.uint64(1)
    word |= (~filled).astype(np.uint64)
    count = np.bincount(of[filled], minlength=len(sets))
    given = filled | (count <= bands.most(n, band))[of]
    return of[given], word[given], np.bincount(of[given], minlength=len(sets))


class _Gathered:
    """Words and sets of one task, sent in packed arrays by bucket."""

    def __init__(self, buckets: int, task: int):
        self.buckets, self.task, self.size = buckets, task, 0
        self.words: list[np.ndarray] = []
        self.sids: list[np.ndarray] = []

    def add(self, words: np.ndarray, sids: np.ndarray) -> None:
        self.words.append(words)
        self.sids.append(sids)
        self.size += len(words)

    def rows(self) -> Iterator[dict]:
        if not self.size:
            return
        words, sids = np.concatenate(self.words), np.concatenate(self.sids)
        self.words, self.sids, self.size = [], [], 0
        order = np.lexsort((sids, words))
        words, sids = words[order], sids[order]
        new = np.concatenate(([True], (words[1:] != words[:-1]) | (sids[1:] != sids[:-1])))
        words, sids = words[new], sids[new]
        starts = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
        counts = np.diff(np.append(starts, len(words)))
        shared = np.repeat(counts >= SHARED, counts)
        summary, many = words[starts][counts >= SHARED], counts[counts >= SHARED]
        if len(summary):  # the sets of shared words go to partitions by set
            self.task += 1
            yield {"kind": _MEMBER, "bucket": self.task % self.buckets, "words": words[shared].tobytes(), "sids": sids[shared].tobytes()}
        words, sids = words[~shared], sids[~shared]
        bucket = mix(words) % np.uint64(self.buckets)
        order = np.argsort(bucket, kind="stable")
        words, sids = words[order], sids[order]
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1, dtype=np.uint64))
        of = mix(summary) % np.uint64(self.buckets)
        for b in range(self.buckets):
            own = of == b
            if edges[b] < edges[b + 1] or own.any():
                yield {
                    "kind": _ENTRY, "bucket": b, "words": words[edges[b] : edges[b + 1]].tobytes(),
                    "sids": sids[edges[b] : edges[b + 1]].tobytes(), "shared": summary[own].tobytes(),
                    "counts": many[own].astype(np.int64).tobytes(),
                }


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


def _sketches(documents: DataFrame, width: int, bands: Bands, buckets: int) -> DataFrame:
    """One row for each document, and the words of all sketches in packed arrays by bucket."""
    schema = _arrow(_MAPPED)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = None
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            for piece in pieces(batch["text"]):
                sets = shingle_sets(piece, width)
                n = np.array([len(s) for s in sets], dtype=np.int64)
                sid = np.array([set_id(s) if len(s) else 0 for s in sets], dtype=np.int64)
                need = np.full((len(sets), 2), np.iinfo(np.int32).min, dtype=np.int64)
                _, one = np.unique(sid, return_index=True)  # equal sets of a piece are sketched once
                one = one[n[one] > 0]
                own = np.searchsorted(bands.low, n[one], side="right") - 1
                below = np.maximum(own - 1, 0)
                for band, use in ((own, bands.words[own] > 0), (below, (own > 0) & (n[one] <= bands.top[below]) & (bands.words[below] > 0))):
                    rows, b = one[use], band[use]
                    of, word, count = sketch_words([sets[i] for i in rows], b, bands)
                    need[rows, b % 2] = bands.most(n[rows], b) + 1 - count
                    if gathered is None:
                        gathered = _Gathered(buckets, int(mix(np.array([sid[0]]).view(np.uint64))[0] % np.uint64(buckets)))
                    gathered.add(word, sid[rows][of])
                where = {int(s): k for k, s in enumerate(sid) if need[k].max() > np.iinfo(np.int32).min}
                yield _batch(
                    [
                        {"kind": _DOCUMENT, "bucket": (int(s) ^ i) % buckets, "doc_id": ids[piece.first + i],
                         "sid": int(s) if size else None, "n": int(size),
                         "need0": int(need[where.get(int(s), i), 0]), "need1": int(need[where.get(int(s), i), 1])}
                        for i, (s, size) in enumerate(zip(sid, n, strict=True))
                    ],
                    schema,
                )
                if gathered is not None and gathered.size >= GATHERED:
                    yield _batch(list(gathered.rows()), schema)
        if gathered is not None and gathered.size:
            yield _batch(list(gathered.rows()), schema)
        pa.default_memory_pool().release_unused()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(mapped, _MAPPED)


def _counted(mapped: DataFrame) -> DataFrame:
    """Documents as they are, and the words that several sets have, each with its sets and their number."""
    schema = _arrow(_REDUCED)

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list[np.ndarray]] = {"words": [], "sids": [], "shared": [], "counts": []}
        for batch in batches:
            kind = np.asarray(batch["kind"])
            if (kind == _DOCUMENT).any():
                own = batch.filter(pa.array(kind == _DOCUMENT))
                empty = pa.nulls(own.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*(own[c] for c in schema.names[:6]), empty, empty], schema=schema)
            for i in np.flatnonzero(kind == _ENTRY):
                for name, held in parts.items():
                    held.append(np.frombuffer(batch[name][int(i)].as_py(), dtype=np.int64 if name in ("sids", "counts") else np.uint64))
            for i in np.flatnonzero(kind == _MEMBER):
                words, sids = (np.frombuffer(batch[c][int(i)].as_py(), dtype=np.int64) for c in ("words", "sids"))
                yield _entries(schema, _MEMBER, words, sids, None)
        if parts["words"]:
            held = {name: np.concatenate(parts.pop(name)) for name in list(parts)}
            range_of, shared_range = (mix(held[c]) >> np.uint64(64 - RANGES.bit_length() + 1) for c in ("words", "shared"))
            for r in range(RANGES):  # sorted copies of a part of the words at a time
                own, of = range_of == r, shared_range == r
                yield from _counted_words(schema, held["words"][own], held["sids"][own], held["shared"][of], held["counts"][of])
        pa.default_memory_pool().release_unused()

    return mapped.repartition("bucket").mapInArrow(reduced, _REDUCED)


def _counted_words(schema: pa.Schema, words: np.ndarray, sids: np.ndarray, shared: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The words that several sets have, and those that some task has sent with their count (``shared``)."""
    order = np.lexsort((sids, words))
    words, sids = words[order], sids[order]
    if len(words):
        new = np.concatenate(([True], (words[1:] != words[:-1]) | (sids[1:] != sids[:-1])))
        words, sids = words[new], sids[new]
    summary, where = np.unique(shared, return_inverse=True)
    more = np.bincount(where, counts, len(summary)).astype(np.int64) if len(shared) else np.zeros(0, dtype=np.int64)
    starts = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1]))) if len(words) else np.zeros(0, dtype=int)
    count = np.diff(np.append(starts, len(words)))
    if len(summary):
        at = np.searchsorted(words[starts], summary)
        hit = np.zeros(len(summary), dtype=bool)
        inside = at < len(starts)
        hit[inside] = words[starts][at[inside]] == summary[inside]
        count[at[hit]] += more[hit]
        total = more.copy()
        total[hit] = count[at[hit]]
        yield _entries(schema, _SHARED, summary.view(np.int64), None, total)
    each = np.repeat(count, np.diff(np.append(starts, len(words))))
    several = each > 1
    yield _entries(schema, _ENTRY, words[several].view(np.int64), sids[several], each[several])


def _entries(schema: pa.Schema, kind: int, words: np.ndarray, sids: np.ndarray | None, counts: np.ndarray | None) -> pa.RecordBatch:
    n = len(words)
    empty = {name: pa.nulls(n, schema.field(name).type) for name in schema.names}
    made = empty | {"kind": pa.array(np.full(n, kind, dtype=np.int32)), "word": pa.array(words)}
    made |= {"sid": pa.array(sids)} if sids is not None else {}
    made |= {"cnt": pa.array(counts)} if counts is not None else {}
    return pa.RecordBatch.from_arrays([made[name] for name in schema.names], schema=schema)


def _first_words(counted: DataFrame) -> DataFrame:
    """``word``, ``sid``, ``n`` and ``alone`` of the words by which a set can meet a similar one: its first T + 1.

    ``alone`` is the number of a set's words that no other set has.
    """
    sets = counted.where(F.col("kind") == _DOCUMENT).where("sid IS NOT NULL").groupBy(F.col("sid").alias("of")).agg(
        F.max("n").alias("n"), F.max("need0").alias("need0"), F.max("need1").alias("need1")
    )
    plain = counted.where(F.col("kind") == _ENTRY).select("word", "sid", "cnt")
    members = counted.where(F.col("kind") == _MEMBER).select("word", "sid").distinct()
    shared = counted.where(F.col("kind") == _SHARED).select(F.col("word").alias("w"), "cnt")
    entries = plain.unionByName(members.join(shared, F.col("word") == F.col("w")).select("word", "sid", "cnt"))
    band = F.shiftright("word", 1).bitwiseAND(1)
    whole = Window.partitionBy("sid", "band")
    order = whole.orderBy(F.col("word").bitwiseAND(1), "cnt", "word")
    need = F.when(F.col("band") == 0, F.col("need0")).otherwise(F.col("need1"))
    return (
        entries.withColumn("band", band)
        .join(sets, F.col("sid") == F.col("of"))
        .withColumn("quota", need + F.count("*").over(whole))
        .withColumn("place", F.row_number().over(order))
        .where("place <= quota")
        .select("word", "sid", "n", (-need).alias("alone"))
    )


def _leader_pairs(words: DataFrame, similarity: int) -> DataFrame:
    """Every set with one set of each of its words: the one with the fewest words of its own, the most central."""
    leaders = words.groupBy(F.col("word").alias("w")).agg(
        F.min(F.struct(-F.col("alone"), F.col("sid").alias("leader"), F.col("n").alias("m"))).alias("l"), F.count("*").alias("c")
    )
    met = words.join(leaders.where("c > 1"), F.col("word") == F.col("w")).select("sid", "n", "l.leader", "l.m")
    fits = F.least("n", "m") * 100 >= F.greatest("n", "m") * similarity
    pair = (F.least("sid", "leader").alias("a"), F.greatest("sid", "leader").alias("b"), (F.col("n") + F.col("m")).alias("total"))
    return met.where("sid <> leader").where(fits).select(*pair).distinct()


def _outside_pairs(words: DataFrame, roots: DataFrame, similarity: int, turn: int) -> DataFrame:
    """Every set outside the largest component of one of its words with one member of that component, another each turn."""
    named = words.join(roots, F.col("sid") == F.col("node"), "left").select("word", "sid", "n", F.coalesce("root", "sid").alias("root"))
    member = F.min_by(F.struct("sid", "n"), F.xxhash64(F.lit(turn), "sid"))
    parts = named.groupBy("word", "root").agg(F.count("*").alias("c"), member.alias("member"))
    main = parts.groupBy(F.col("word").alias("w")).agg(
        F.max_by(F.struct("root", "member"), F.struct("c", "root")).alias("main"), F.count("*").alias("parts")
    )
    met = named.join(main.where("parts > 1"), (F.col("word") == F.col("w")) & (F.col("root") != F.col("main.root")))
    met = met.select("sid", "n", F.col("main.member.sid").alias("other"), F.col("main.member.n").alias("m"))
    fits = F.least("n", "m") * 100 >= F.greatest("n", "m") * similarity
    return met.where(fits).select(F.least("sid", "other").alias("a"), F.greatest("sid", "other").alias("b"), (F.col("n") + F.col("m")).alias("total")).distinct()


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` with components joined by further ``links``; only components that a link names are touched."""
    known = roots.select("node", "root")
    named = links
    for c in ("a", "b"):
        own = known.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        named = named.join(own, c, "left").withColumn(c, F.coalesce(f"r{c}", c)).drop(f"r{c}")
    between = named.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    joined = components(between).select(F.col("node").alias("old"), F.col("root").alias("new"))
    moved = known.join(joined, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
    alone = joined.join(known, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("root"))
    return stored(moved.union(alone), "jaccard-roots")


def _open_pairs(words: DataFrame, roots: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Sets that share a word, are in different components and may be similar.

    Of each word the sets outside the component that most of its sets are in are held against all others of it. Most words
    have few sets, and the same ones as other words: their pairs are made of ids, and each is kept once. The sets of other
    words come in blocks of bounded size with their brief bit sketches, and a pair of blocks is compared at once: only close
    pairs become rows.
    """
    named = words.join(roots, F.col("sid") == F.col("node"), "left").select(
        "word", "sid", "n", F.coalesce("root", "sid").alias("root")
    )
    parts = named.groupBy("word", "root").agg(F.count("*").alias("c"))
    several = parts.groupBy(F.col("word").alias("w")).agg(
        F.max_by("root", F.struct("c", "root")).alias("main"), F.sum("c").alias("all"), F.count("*").alias("parts")
    )
    met = named.join(several.where("parts > 1"), F.col("word") == F.col("w")).select("word", "sid", "n", "root", "main", "all")
    met = stored(met, "jaccard-shared")
    few, many = met.where(F.col("all") <= FEW), met.where(F.col("all") > FEW)
    return _few_pairs(few, similarity).union(_block_pairs(many, sets, similarity)).distinct()


def _few_pairs(met: DataFrame, similarity: int) -> DataFrame:
    """The pairs of each word, told by ids and sizes alone; ``met`` has few sets of a word."""
    held = met.groupBy("word", "main").agg(F.collect_list(F.struct("sid", "n", "root")).alias("sets"))
    outside = F.filter("sets", lambda s: s["root"] != F.col("main"))
    pairs = held.select(F.explode(outside).alias("x"), "sets").select("x", F.explode("sets").alias("y")).where("x.root <> y.root")
    n, m = F.col("x.n"), F.col("y.n")
    return pairs.where(F.least(n, m) * 100 >= F.greatest(n, m) * similarity).select(
        F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b"), (n + m).alias("total")
    )


def _block_pairs(met: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs whose brief bit sketches are close, from blocks of the sets of a word."""
    block = F.pmod(F.xxhash64("sid"), F.ceil(F.col("all") / BLOCK_SETS))
    own = F.struct("sid", "n", "root", "brief")
    held = (
        met.join(sets.select(F.col("sid").alias("of"), "brief"), F.col("sid") == F.col("of"))
        .groupBy("word", "main", block.alias("block"))
        .agg(F.collect_list(own).alias("sets"))
    )
    held = stored(held, "jaccard-blocks")
    outside = F.filter("sets", lambda s: s["root"] != F.col("main"))
    odd = held.select(F.col("word").alias("w"), outside.alias("odd")).where(F.size("odd") > 0)
    pairs = held.select("word", "sets").join(odd, F.col("word") == F.col("w")).select("odd", "sets")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_close_pairs(odd.as_py(), all_.as_py(), similarity) for odd, all_ in zip(batch["odd"], batch["sets"], strict=True)]
            both = np.unique(np.concatenate(found, axis=0), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, c]) for c in range(3)], names=["a", "b", "total"])

    return pairs.mapInArrow(close, "a long, b long, total long")


def _close_pairs(odd: list[dict], others: list[dict], similarity: int) -> np.ndarray:
    """Rows (a, b, total of sizes), a < b, of different components, similar sizes and close bit sketches."""
    width = min(len(s["brief"]) for s in (*odd, *others)) // 8

    def table(sets: list[dict]) -> tuple[np.ndarray, ...]:
        bits = [np.frombuffer(s["brief"], dtype=np.uint64).reshape(-1, width) for s in sets]
        folded = np.stack([np.bitwise_xor.reduce(b, axis=0) if len(b) > 1 else b[0] for b in bits])
        return folded, *(np.array([s[c] for s in sets], dtype=np.int64) for c in ("sid", "n", "root"))

    x, sid, n, root = table(odd)
    y, sids, m, roots = table(others)
    out = [np.zeros((0, 3), dtype=np.int64)]
    for i in range(len(odd)):
        fits = np.flatnonzero((roots != root[i]) & (100 * np.minimum(m, n[i]) >= similarity * np.maximum(m, n[i])))
        if len(fits):
            away = np.bitwise_count(y[fits] ^ x[i]).sum(axis=1, dtype=np.int64)
            near = fits[away <= (m[fits] + n[i]) * (100 - similarity) // (100 + similarity)]
            out.append(np.stack((np.minimum(sids[near], sid[i]), np.maximum(sids[near], sid[i]), m[near] + n[i]), axis=1))
    return np.concatenate(out)


def _bits(shingles: np.ndarray, times: int = 8) -> np.ndarray:
    """Bit sketch: parity of the hashes at each of at least ``times`` n positions, a power of two."""
    size = max(64, 1 << int(times * len(shingles) - 1).bit_length())
    at = mix(shingles + np.uint64(0x2545F4914F6CDD1D)) & np.uint64(size - 1)
    odd = (np.bincount(at.astype(np.int64), minlength=size) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def _difference(x: np.ndarray, y: np.ndarray) -> int:
    """Hamming distance of two bit sketches; the larger one is folded to the size of the smaller, which keeps parities."""
    if len(x) < len(y):
        x, y = y, x
    folded = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(folded ^ y).sum())


def _bit_filter(rows: DataFrame, column: str) -> Broadcast:
    """A filter of bounded size of the ids in ``column``: the bit of each id, by its remainder, is set."""
    count = rows.count()
    size = min(FILTER_BITS, max(1 << 16, 1 << (16 * count).bit_length()))
    at = F.pmod(column, F.lit(size))
    bit = F.expr(f"shiftleft(1L, cast(pmod(pmod({column}, {size}L), 64L) AS int))")
    table = rows.groupBy((at / 64).cast("long").alias("w")).agg(F.bit_or(bit).alias("v")).toArrow()
    held = np.zeros(size // 64, dtype=np.int64)
    held[np.asarray(table["w"])] = np.asarray(table["v"])
    return rows.sparkSession.sparkContext.broadcast(held)


def _may_hold(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ``ids`` the filter may have: all that it was made of, and a few others."""
    at = ids % (64 * len(bits))
    return (bits[at // 64] >> (at % 64)) & 1 == 1


def _wanted_sets(documents: DataFrame, sids: DataFrame, width: int) -> DataFrame:
    """``sid``, ``brief``, ``bits`` and ``shingles`` of the sets named, from the texts; a bit filter passes the other texts by
    (and lets a few through)."""
    passed = _bit_filter(sids, "sid")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = passed.value, set()
        for batch in batches:
            for piece in pieces(batch["text"]):
                rows = []
                sets = [s for s in shingle_sets(piece, width) if len(s)]
                named = np.array([set_id(s) for s in sets], dtype=np.int64)
                for k in np.flatnonzero(_may_hold(bits, named)):
                    sid, shingles = int(named[k]), sets[k]
                    if sid in seen:
                        continue
                    seen.add(sid)
                    rows.append((sid, _bits(shingles, 4).tobytes(), _bits(shingles).tobytes(), shingles.tobytes()))
                if rows:
                    columns = zip(zip(*rows, strict=True), (pa.int64(), *[pa.binary()] * 3), strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, kind) for c, kind in columns], names=["sid", "brief", "bits", "shingles"]
                    )

    texts = documents.select(F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(made, "sid long, brief binary, bits binary, shingles binary").join(sids, "sid", "left_semi").dropDuplicates(["sid"])


def _with_both(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """``pairs`` with the ``column`` of both sets as ``x`` and ``y``."""
    first = sets.select(F.col("sid").alias("a"), F.col(column).alias("x"))
    second = sets.select(F.col("sid").alias("b"), F.col(column).alias("y"))
    return pairs.join(first, "a").join(second, "b").select(*pairs.columns, "x", "y")


def _close(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (``a``, ``b``, ``total`` of their sizes) whose bit sketches are close enough: the Hamming distance of two
    sketches is at most the symmetric difference of their sets."""

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = np.asarray(batch["total"]) * (100 - similarity) // (100 + similarity)
            keep = [
                _difference(np.frombuffer(x.as_py(), dtype=np.uint64), np.frombuffer(y.as_py(), dtype=np.uint64)) <= m
                for x, y, m in zip(batch["x"], batch["y"], most, strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _with_both(pairs, sets, "bits").mapInArrow(close, "a long, b long")


def _linked(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs whose sets are similar."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                a, b = (np.frombuffer(s.as_py(), dtype=np.uint64) for s in (x, y))
                both = np.concatenate((a, b))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= similarity * (len(a) + len(b) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _with_both(pairs, sets, "shingles").mapInArrow(linked, "a long, b long")


def _groups(documents: DataFrame, similarity: int, width: int) -> tuple[DataFrame, DataFrame]:
    """A row of ``doc_id``, ``sid`` and ``n`` for each document, and ``node`` and ``root`` of the sets that link."""
    buckets = 4 * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = stored(_counted(_sketches(documents, width, Bands.of(similarity), buckets)), "jaccard-words")
    words = stored(_first_words(counted), "jaccard-first")
    sets = stored(_wanted_sets(documents, words.select("sid").distinct(), width), "jaccard-sets")
    leading = _close(stored(_leader_pairs(words, similarity), "jaccard-leaders"), sets, similarity)
    roots = stored(components(_linked(leading, sets, similarity)), "jaccard-roots")
    for turn in range(ROUNDS):
        asked = _close(stored(_outside_pairs(words, roots, similarity, turn), "jaccard-outside"), sets, similarity)
        links = stored(_linked(asked, sets, similarity), "jaccard-links")
        if links.isEmpty():
            break
        roots = _merged(roots, links)
    rest = stored(_open_pairs(words, roots, sets, similarity), "jaccard-pairs")
    rest = _close(rest, sets, similarity)
    links = stored(_linked(rest, sets, similarity), "jaccard-links")
    return counted.where(F.col("kind") == _DOCUMENT).select("doc_id", "sid", "n"), _merged(roots, links)


def near_duplicates(documents: DataFrame, similarity: int = SIMILARITY, width: int = SHINGLE) -> DataFrame:
    """For every row: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest doc_id reachable by links.

    A text of fewer than ``width`` words is one shingle. Without words or text (null) a row has 0 shingles, links with
    nothing and is its own component. Equal texts link; a null doc_id counts as none, so it is never the smallest.
    """
    rows, roots = _groups(documents, similarity, width)
    keyed = rows.join(roots, F.col("sid") == F.col("node"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "sid").alias("key")
    )
    least = keyed.where("key IS NOT NULL").groupBy(F.col("key").alias("of")).agg(F.min("doc_id").alias("component_id"))
    return keyed.join(least, F.col("key") == F.col("of"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def representatives(documents: DataFrame, similarity: int = SIMILARITY, width: int = SHINGLE) -> DataFrame:
    """One row of each component, with all its columns: the one of the smallest doc_id (null last), of equal ids the one of
    the least hash of its columns. Rows without words stay. Rows are named by their content, which every scan sees alike;
    rows that are equal in all columns are told apart only where they would all stay, and one of them does.
    """

    @F.arrow_udf("long")
    def identified(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            sets = (s for piece in pieces(texts) for s in shingle_sets(piece, width))
            yield pa.array([set_id(s) if len(s) else None for s in sets], pa.int64())

    hashed = [c for c, kind in documents.dtypes if "map<" not in kind and "variant" not in kind]
    content = [F.xxhash64(F.lit(k), *[F.struct(F.isnull(c), c) for c in hashed]).alias(f"__h{k}") for k in (1, 2)]
    name = ["__h1", "__h2"]
    _, roots = _groups(documents, similarity, width)
    keyed = documents.select("doc_id", identified("text").alias("sid"), *content).where("sid IS NOT NULL")
    keyed = stored(keyed.join(roots, F.col("sid") == F.col("node"), "left").select(
        F.coalesce("root", "sid").alias("key"), F.struct(F.col("doc_id").isNull(), "doc_id", *name).alias("place"), *name
    ), "jaccard-keys")
    first = keyed.groupBy(F.col("key").alias("of")).agg(F.min("place").alias("first"), F.count("*").alias("c")).where("c > 1")
    judged = keyed.join(first, F.col("key") == F.col("of")).groupBy(*name).agg(
        F.first(F.col("place") == F.col("first")).alias("stays"), F.count("*").alias("c")
    )
    judged = stored(judged.where("NOT stays OR c > 1"), "jaccard-judged")
    dropped, repeated = judged.where("NOT stays").select(name), judged.where("stays").select(name)
    passed = _bit_filter(judged, "__h1")

    @F.arrow_udf("boolean")
    def asked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for hashes in batches:
            yield pa.array(_may_hold(passed.value, np.asarray(hashes)))

    # a bit filter tells most rows that stay: only the texts of the others may be shuffled
    told = documents.select("*", *content).withColumn("__asked", asked("__h1"))
    left = told.where("__asked").join(dropped, name, "left_anti")
    once = left.join(repeated, name, "left_semi").dropDuplicates(name)
    kept = left.join(repeated, name, "left_anti").select(documents.columns).union(once.select(documents.columns))
    return told.where("NOT __asked").select(documents.columns).union(kept)


#: The same as SQL.
NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT r, g FROM (
    SELECT r, w[i : i + 4] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
    UNION ALL SELECT r, w AS g FROM d WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
common AS (SELECT s.r AS a, t.r AS b, count(*) AS k FROM s JOIN s AS t ON s.g = t.g AND s.r < t.r GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN n AS x ON x.r = a JOIN n AS y ON y.r = b
  WHERE 100 * k >= 80 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(e.doc_id) AS component_id
FROM d LEFT JOIN n USING (r) JOIN reach ON reach.a = d.r JOIN d AS e ON e.r = reach.b
GROUP BY d.r, d.doc_id, n.n
"""
