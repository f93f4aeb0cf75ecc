"""How far the sources of a language diverge: term counts by a perfect-hash recount.

* Document frequencies are counted exactly, by term, with the rows of a task combined before the shuffle. A language keeps
  the terms that enough of its documents hold.
* Kept terms are dealt by hash into shards of bounded size. A task gives the terms of a shard slots by a minimal perfect hash
  and keeps the terms in slot order.
* The shards are broadcast in rounds of bounded size, one round unless there are very many terms. A task looks the different
  words of a piece of text up, compares each with the term kept at its slot, and increments dense pages of its group's slots.
  Pages are flushed at a bound, as the counts that are not 0, and those of one group and block are added up after a shuffle.
* A page is complete: every group has every block of its language. Pairs of sources meet in tiles of sources by block, so
  that a task holds two tiles of one block whatever the number of sources and terms; the output has one row for each pair.

Counts are whole numbers and shares are floors of exact quotients. Null texts, languages and sources are empty strings;
equal rows all count; doc_id plays no part. An empty table gives no rows. A language without kept terms has pairs of 0.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.perfect_hash import PerfectHash
from gridspark.llm.tables import stored
from gridspark.llm.text import LETTERS, pieces

#: Documents of a language that a kept term occurs in.
DOCUMENTS = 30
#: Bytes of the terms of a shard, about.
SHARD_BYTES = 1 << 20
#: Bytes of the shards that are broadcast at once.
ROUND_BYTES = 64 << 20
#: Bytes of text that are cut into words at once.
TEXT_BYTES = 1 << 19
#: Slots of a page, pages that a task holds, different terms that it holds before they are combined.
PAGE, PAGES, HELD = 512, 1 << 14, 1 << 18
#: Sources of a tile.
TILE = 32
#: Shares count in billionths; each term has as many occurrences more.
SCALE_DIGITS, EXTRA = 3, 5

_PAGE_ROWS = "lang string, source string, block long, places array<smallint>, counts array<long>, total long"


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """``1 + floor(10**9 * (count + EXTRA) / (total + EXTRA * terms))``, digit by digit to base 1000, so without overflow."""
    whole = total + EXTRA * terms
    if whole >= (1 << 63) // 1000:
        raise OverflowError("a group has more than 9e15 words")
    rest, out = counts.astype(np.int64) + EXTRA, np.zeros(len(counts), dtype=np.int64)
    for _ in range(SCALE_DIGITS):
        digit, rest = np.divmod(rest * 1000, max(whole, 1))
        out = out * 1000 + digit
    return out + 1


def _coded(column: pa.Array) -> tuple[list[str], np.ndarray]:
    coded = pc.fill_null(column, "").dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy()


def _digests(terms: pa.Array) -> np.ndarray:
    """128 bits of each string, as two lanes."""
    _, where, data = terms.buffers()
    kind = np.int64 if pa.types.is_large_string(terms.type) else np.int32
    ends = np.frombuffer(where, dtype=kind)[terms.offset : terms.offset + len(terms) + 1].tolist()
    view = memoryview(data) if data is not None else memoryview(b"")
    joined = b"".join(xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(ends, ends[1:]))
    return np.frombuffer(joined, dtype=np.uint64).reshape(-1, 2)


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    for batch in batches:
        names, langs = _coded(batch.column("lang"))
        for piece in pieces(batch.column("text"), TEXT_BYTES):
            words, text = piece.words(LETTERS)
            codes, kinds = words.indices.to_numpy().astype(np.int64), max(len(words.dictionary), 1)
            once = np.unique(text * kinds + codes)
            of = langs[piece.first + once // kinds].astype(np.int64)
            found, n = np.unique(of * kinds + once % kinds, return_counts=True)
            terms = words.dictionary.take(pa.array(found % kinds))
            held.append(pa.table({"lang": pa.array(names, pa.string()).take(pa.array(found // kinds)), "term": terms, "n": pa.array(n, pa.int64())}))
            if sum(t.num_rows for t in held) > HELD:
                held = [_added_up(held)]
                if held[0].num_rows > HELD // 2:
                    yield from _sent(held.pop())
    if held:
        yield from _sent(_added_up(held))


def _added_up(held: list[pa.Table]) -> pa.Table:
    grouped = pa.concat_tables(held).group_by(["lang", "term"]).aggregate([("n", "sum")])
    return grouped.rename_columns(["lang", "term", "n"])


def _sent(counted: pa.Table) -> list[pa.RecordBatch]:
    return counted.set_column(1, "term", counted["term"].cast(pa.string())).to_batches()


def kept_terms(documents: DataFrame, least: int = DOCUMENTS) -> DataFrame:
    """``lang`` and ``term`` of the terms that at least so many documents of the language hold."""
    partial = documents.select("lang", "text").mapInArrow(_document_frequencies, "lang string, term string, n long")
    return partial.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "term")


@dataclass
class Shard:
    """Slots ``first`` and up of the terms of a shard, ``terms[slot - first]`` being the term kept at a slot."""

    first: int
    hash: PerfectHash
    terms: pa.Array

    def slots(self, words: pa.Array, digests: np.ndarray) -> np.ndarray:
        found = self.hash.slots(digests)
        there = np.flatnonzero(found >= 0)
        same = pc.equal(self.terms.take(pa.array(found[there])), words.take(pa.array(there))).to_numpy(zero_copy_only=False)
        out = np.full(len(found), -1, dtype=np.int64)
        out[there[same]] = found[there[same]] + self.first
        return out


def _dealt(n_shards: int) -> Callable:
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = (_digests(batch.column("term"))[:, 0] % np.uint64(n_shards)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], names=["lang", "term", "shard"])

    return deal


def _build(group: pa.Table) -> pa.Table:
    terms = group["term"].combine_chunks().cast(pa.large_string())
    digests = _digests(terms)
    made = PerfectHash.of(digests)
    kept = terms.take(pa.array(np.argsort(made.slots(digests))))
    blob = pickle.dumps((made, kept))
    return pa.table({"lang": group["lang"][:1], "shard": group["shard"][:1], "n": [len(kept)], "size": [len(blob)], "blob": pa.array([blob], pa.binary())})


def shards(terms: DataFrame) -> DataFrame:
    """One row for each shard of a language: ``n`` terms and the pickled perfect hash with its terms."""
    total = terms.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    n_shards = -(-total // SHARD_BYTES) or 1
    dealt = terms.mapInArrow(_dealt(n_shards), "lang string, term string, shard long")
    return dealt.groupBy("lang", "shard").applyInArrow(_build, "lang string, shard long, n long, size long, blob binary")


def _rounds(held: DataFrame) -> tuple[list[list[tuple[str, int, int]]], int]:
    """The shards in rounds of bounded size, each (language, shard, first slot), and the number of shards a language is dealt to."""
    rows = held.select("lang", "shard", "n", "size").orderBy("lang", "shard").collect()
    rounds: list[list[tuple[str, int, int]]] = []
    first: dict[str, int] = {}
    room = 0
    for row in rows:
        if row["size"] > room or not rounds:
            rounds.append([])
            room = ROUND_BYTES
        room -= row["size"]
        rounds[-1].append((row["lang"], row["shard"], first.get(row["lang"], 0)))
        first[row["lang"]] = first.get(row["lang"], 0) + row["n"]
    return rounds, 1 + max((row["shard"] for row in rows), default=0)


class _Pages:
    """Dense pages of counts of some groups, by (group, block)."""

    def __init__(self) -> None:
        self.rows: dict[tuple, int] = {}
        self.counts = np.zeros((PAGES, PAGE), dtype=np.int64)

    def add(self, lang: str, sources: list[str], source: np.ndarray, slot: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Count slots of words, each in the source of its code; full pages come out."""
        blocks, block = np.unique(slot // PAGE, return_inverse=True)
        page, place = np.unique(source.astype(np.int64) * max(len(blocks), 1) + block, return_inverse=True)
        order = np.argsort(place, kind="stable")
        place, slot = place[order], slot[order] % PAGE
        for a in range(0, len(page), PAGES // 4):
            some = page[a : a + PAGES // 4]
            i, j = np.searchsorted(place, (a, a + len(some)))
            if len(self.rows) + len(some) > PAGES:
                yield self.flush()
            keys = [(lang, sources[p // len(blocks)], int(blocks[p % len(blocks)])) for p in some.tolist()]
            rows = np.array([self.rows.setdefault(k, len(self.rows)) for k in keys])
            self.counts[rows] += np.bincount((place[i:j] - a) * PAGE + slot[i:j], minlength=len(some) * PAGE).reshape(-1, PAGE)

    def flush(self) -> pa.RecordBatch:
        counts = self.counts[: len(self.rows)]
        out = _page_batch(list(self.rows), counts)
        self.rows = {}
        counts[:] = 0
        return out


def _page_batch(keys: list[tuple[str, str, int]], counts: np.ndarray) -> pa.RecordBatch:
    row, place = np.nonzero(counts)
    ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(keys))))), pa.int32())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k[0] for k in keys], pa.string()),
            pa.array([k[1] for k in keys], pa.string()),
            pa.array([k[2] for k in keys], pa.int64()),
            pa.ListArray.from_arrays(ends, pa.array(place, pa.int16())),
            pa.ListArray.from_arrays(ends, pa.array(counts[row, place], pa.int64())),
            pa.array(counts.sum(axis=1), pa.int64()),
        ],
        names=["lang", "source", "block", "places", "counts", "total"],
    )


def _page(places: list[int] | None, counts: list[int] | None, width: int) -> np.ndarray:
    """The dense counts of one page; a missing page has none."""
    page = np.zeros(width, dtype=np.int64)
    if places:
        page[places] = counts
    return page


def _recount(tables: Broadcast, n_shards: int) -> Callable:
    def recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages = _Pages()
        for batch in batches:
            langs, lang = _coded(batch.column("lang"))
            sources, source = _coded(batch.column("source"))
            for piece in pieces(batch.column("text"), TEXT_BYTES):
                words, text = piece.words(LETTERS)
                codes, different = words.indices.to_numpy(), words.dictionary
                digests = _digests(different)
                shard_of = (digests[:, 0] % np.uint64(n_shards)).astype(np.int64)
                of_word = lang[piece.first + text]
                for k in np.unique(of_word):
                    own = tables.value.get(langs[k])
                    if own is None:
                        continue
                    mine = np.flatnonzero(of_word == k)
                    used = np.flatnonzero(np.bincount(codes[mine], minlength=len(different)))
                    slots = np.full(len(different), -1, dtype=np.int64)
                    for number, shard in own.items():
                        asked = used[shard_of[used] == number]
                        slots[asked] = shard.slots(different.take(pa.array(asked)), digests[asked])
                    mine = mine[slots[codes[mine]] >= 0]
                    yield from pages.add(langs[k], sources, source[piece.first + text[mine]], slots[codes[mine]])
        yield pages.flush()

    return recount


def _add_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up neighbouring pages of one group and block."""
    last, total = None, np.zeros((1, PAGE), dtype=np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
        new = np.array([i == 0 or k != keys[i - 1] for i, k in enumerate(keys)])
        run = np.repeat(np.cumsum(new) - 1, pc.list_value_length(batch.column(3)).to_numpy())
        sums = np.zeros((int(new.sum()), PAGE), dtype=np.int64)
        np.add.at(sums, (run, batch.column(3).flatten().to_numpy()), batch.column(4).flatten().to_numpy())
        names = [keys[i] for i in np.flatnonzero(new)]
        if last is not None:
            if names[0] == last:
                sums[0] += total[0]
            else:
                names, sums = [last, *names], np.concatenate((total, sums))
        yield _page_batch(names[:-1], sums[:-1])
        last, total = names[-1], sums[-1:].copy()
    if last is not None:
        yield _page_batch([last], total)


def _sums(pages: DataFrame) -> DataFrame:
    dealt = pages.repartition("lang", "source", "block").sortWithinPartitions("lang", "source", "block")
    return dealt.mapInArrow(_add_pages, _PAGE_ROWS)


def recounted(documents: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages of counts of every group that has kept terms, and the terms by ``lang`` and ``block``."""
    spark = documents.sparkSession
    rounds, n_shards = _rounds(held)
    pages = spark.createDataFrame([], _PAGE_ROWS)
    for some in rounds:
        names = F.broadcast(spark.createDataFrame(some, "lang string, shard long, first long"))
        tables: dict[str, dict[int, Shard]] = {}
        for row in held.join(names, ["lang", "shard"]).select("lang", "shard", "first", "blob").toLocalIterator():
            tables.setdefault(row["lang"], {})[row["shard"]] = Shard(row["first"], *pickle.loads(row["blob"]))
        sent = spark.sparkContext.broadcast(tables)
        part = stored(documents.mapInArrow(_recount(sent, n_shards), _PAGE_ROWS), "pages")
        sent.destroy()
        pages = pages.union(part)
    starts = F.broadcast(spark.createDataFrame(list(chain(*rounds)), "lang string, shard long, first long"))
    placed = held.join(starts, ["lang", "shard"]).select("lang", "first", "blob")
    terms = placed.mapInArrow(_listed, "lang string, slot long, term string")
    return stored(_sums(pages), "page-sums"), terms


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, first, blob in zip(*(c.to_pylist() for c in batch.columns)):
            terms = pickle.loads(blob)[1]
            slots = pa.array(first + np.arange(len(terms)), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), slots, terms.cast(pa.string())], names=["lang", "slot", "term"])


def _by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, which follow each other."""
    held: pa.Table | None = None
    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        codes = list(zip(*(held[k].to_pylist() for k in keys)))
        cuts = [i for i in range(1, len(codes)) if codes[i] != codes[i - 1]]
        for a, b in zip([0, *cuts], cuts):
            yield held.slice(a, b - a)
        held = held.slice(cuts[-1] if cuts else 0)
    if held is not None and held.num_rows:
        yield held


def _tile_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, names, sums = None, ([], []), np.zeros((0, 0), dtype=np.int64)

    def rows() -> pa.RecordBatch:
        lang, ti, tj = now
        a, b = (np.repeat(np.arange(len(names[0])), len(names[1])), np.tile(np.arange(len(names[1])), len(names[0])))
        values = sums.reshape(-1)
        first, second = (pa.array(n, pa.string()).take(pa.array(i)) for n, i in zip(names, (a, b)))
        if ti == tj:
            keep = pa.array(a != b)
            columns = [first.filter(keep), second.filter(keep), pa.array(values[a != b])]
        else:
            columns = [pa.concat_arrays([first, second]), pa.concat_arrays([second, first]), pa.array(np.concatenate((values, values)))]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(columns[0]), pa.string()), *columns], names=["lang", "source", "item", "value"])

    for one in _by_key(batches, ["lang", "ti", "tj", "block"]):
        lang, ti, tj, block = (one[c][0].as_py() for c in ("lang", "ti", "tj", "block"))
        terms = one["terms"][0].as_py()
        width = max(0, min(PAGE, terms - PAGE * block))
        tiles: dict[int, tuple[list[str], list[np.ndarray]]] = {ti: ([], []), tj: ([], [])}
        columns = (one[c].to_pylist() for c in ("tile", "source", "total", "places", "counts"))
        for tile, source, total, places, counts in sorted(zip(*columns), key=lambda r: r[:2]):
            tiles[tile][0].append(source)
            tiles[tile][1].append(shares(_page(places, counts, width), total, terms))
        x, y = (np.array(tiles[t][1]).reshape(len(tiles[t][0]), width) for t in (ti, tj))
        found = np.abs(x[:, None, :] - y[None, :, :]).sum(axis=2)
        if (lang, ti, tj) == now:
            sums += found
        else:
            if now is not None:
                yield rows()
            now, names, sums = (lang, ti, tj), (tiles[ti][0], tiles[tj][0]), found
    if now is not None:
        yield rows()


def pair_divergence(dense: DataFrame) -> DataFrame:
    """Sum of the differences of shares of every two sources of a language."""
    tile = F.col("number").cast("long")
    tiled = dense.withColumn("tile", F.floor((tile - 1) / TILE)).withColumn("tiles", F.ceil(F.col("n_sources") / TILE))
    both = tiled.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    keyed = both.withColumn("ti", F.least("tile", "other")).withColumn("tj", F.greatest("tile", "other"))
    keyed = keyed.select("lang", "ti", "tj", "block", "tile", "source", "terms", "total", "places", "counts")
    dealt = keyed.repartition("lang", "ti", "tj", "block").sortWithinPartitions("lang", "ti", "tj", "block")
    sums = dealt.mapInArrow(_tile_sums, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _over_represented(top: int) -> Callable:
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                width = len(row["names"])
                counts = _page(row["places"], row["counts"], width)
                p = shares(counts, row["total"], row["terms"])
                q = shares(_page(row["lang_places"], row["lang_counts"], width), row["lang_total"], row["terms"])
                hits = np.flatnonzero((counts > 0) & (p > q))
                best = sorted(((int(q[i] - p[i]), row["names"][i].encode(), i) for i in hits.tolist()))[:top]
                out += [(row["lang"], row["source"], row["names"][i], -f) for f, _, i in best]
            columns = list(zip(*out)) if out else [[], [], [], []]
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "source", "item", "value"])

    return over


def over_represented(pages: DataFrame, terms: DataFrame, langs: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """The terms of each group whose share exceeds the language's, the best ``top`` of each block."""
    in_lang = _sums(pages.withColumn("source", F.lit(""))).select("lang", "block", F.col("places").alias("lang_places"), F.col("counts").alias("lang_counts"))
    block = F.floor(F.col("slot") / PAGE).alias("block")
    names = terms.groupBy("lang", block).agg(F.sort_array(F.collect_list(F.struct("slot", "term"))).alias("n"))
    known = in_lang.join(names.select("lang", "block", F.col("n.term").alias("names")), ["lang", "block"])
    totals = groups.select("lang", "source", F.col("total"), "terms", "lang_total")
    rows = pages.drop("total").join(known, ["lang", "block"]).join(totals, ["lang", "source"])
    return rows.mapInArrow(_over_represented(top), "lang string, source string, item string, value long")


def audit(documents: DataFrame, least: int = DOCUMENTS, top: int = 50) -> DataFrame:
    """Per (``lang``, ``source``): part ``pair``, the divergence from every other source of the language, and part
    ``term``, its ``top`` over-represented terms; ``rank`` by falling ``value``, then ``item``."""
    empty = {c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")}
    docs = documents.select(*empty.values(), F.col("text").cast("string").alias("text"))
    held = stored(shards(stored(kept_terms(docs, least), "terms")), "shards")
    pages, terms = recounted(docs, held)
    in_group = pages.groupBy("lang", "source").agg(F.sum("total").alias("total"))
    every = docs.select("lang", "source").distinct().join(in_group, ["lang", "source"], "left")
    every = every.withColumn("total", F.coalesce("total", F.lit(0)))
    of_lang = every.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count("*").alias("n_sources"))
    n_terms = held.groupBy("lang").agg(F.sum("n").alias("terms"))
    langs = of_lang.join(n_terms, "lang", "left").withColumn("terms", F.coalesce("terms", F.lit(0)))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).alias("number")
    groups = stored(every.join(langs, "lang").select("lang", "source", "total", "lang_total", "n_sources", "terms", number), "groups")
    last = F.greatest(F.ceil(F.col("terms") / PAGE), F.lit(1)) - 1
    dense = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    dense = dense.join(pages.drop("total"), ["lang", "source", "block"], "left")
    parts = {"pair": pair_divergence(dense), "term": over_represented(pages, terms, langs, groups, top)}
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = {n: p.select("lang", "source", F.lit(n).alias("part"), "item", "value", F.row_number().over(best).alias("rank")) for n, p in parts.items()}
    return ranked["pair"].union(ranked["term"].where(F.col("rank") <= top))


AUDIT_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n_lang FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(n_lang) AS HUGEINT) AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
n AS (SELECT lang, source, CAST(sum(c) AS HUGEINT) AS n FROM c GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c,
         1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c, 0) + 5)) // (coalesce(n.n, 0) + 5 * v.v) AS p,
         1 + (CAST(1000000000 AS HUGEINT) * (n_lang + 5)) // (v.n + 5 * v.v) AS q
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
