"""Prefix trie of conversations, with node tables behind minimal perfect hashes.

A node is a distinct sequence of first turns. Its digest XORs one 128-bit hash of (depth, turn) for every turn, so digests
of prefixes are running sums that segments of a conversation can compute apart, and no task holds a conversation. Texts
are hashed where they are read (SHA-256 of role and text) and travel no further.

* Counts. Every task takes its rows in shards of bounded size, gives their distinct digests slots by a minimal perfect
  hash, checks the key, parent and turn kept at a slot against every row, and scatters counts and least members into flat
  arrays. One row for each node of a shard is combined with those of other shards, so the root and turns that very many
  conversations start with are counted before they are shuffled.
* Subtree sums. A node's own value is given to its least member alone. Each shard of whole segments accumulates the
  values through parent slots, deepest first; the shards' sums of a node add up to its subtree, as every value reaches
  all its ancestors in the one shard that holds it. What lies in later segments of a conversation enters at the last
  turn of the earlier ones.
* Lists of members that end at a node are written down in order, range by range, and hashed range after range.

Rows without conv_id take no part; turns that are equal in number are ordered by the digest of role and text, equal rows
all count. Null roles and texts are empty. An empty table has no nodes. Two different prefixes with one digest are an error
of the query, not a wrong row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.perfect_hash import SlotTable
from gridspark.llm.tables import stored

#: Turns of a segment of a conversation.
SEGMENT = 1 << 10
#: Rows of a shard, about.
SHARD_ROWS = 1 << 17
#: Members of a node that are written down as one text.
LISTED = 1 << 14
#: A node with more than this share of all nodes as children is looked up by broadcast: at most so many nodes.
HOT_NODES = 1000

_PARTIAL = "d1 long, d2 long, p1 long, p2 long, turn binary, depth long, chars long, n long, conv_id long, n_ends long"
_SUMS = "d1 long, d2 long, n_leaves long, saved long"


def _segment(position: Column) -> Column:
    return F.shiftright(position, SEGMENT.bit_length() - 1)


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``position`` (from 0), ``turn`` (digest of role and text), ``chars`` and the conversation's ``length``."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("number"),
        F.unhex(F.sha2(said, 256)).alias("turn"),
        F.char_length(text).cast("long").alias("chars"),
        F.coalesce(_segment(F.col("turn").cast("long")), F.lit(-(1 << 62))).alias("seg"),
    )
    group = Window.partitionBy("c")
    sizes = rows.groupBy(F.col("conv_id").alias("c"), F.col("seg").alias("s")).agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(group.orderBy("s").rowsBetween(Window.unboundedPreceding, -1))
    counted = sizes.select("c", "s", F.coalesce(earlier, F.lit(0)).alias("before"), F.sum("n").over(group).alias("length"))
    inside = Window.partitionBy("conv_id", "seg").orderBy(F.col("number").asc_nulls_first(), "turn")
    numbered = rows.withColumn("i", F.row_number().over(inside))
    joined = numbered.join(counted, (F.col("conv_id") == F.col("c")) & (F.col("seg") == F.col("s")))
    return joined.select("conv_id", (F.col("before") + F.col("i") - 1).alias("position"), "turn", "chars", "length")


def with_shared_openings(said: DataFrame, of: Column, opening: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Put the first turns of another conversation in place of a conversation's own.

    ``of`` and ``opening`` are expressions on ``conv_id``: whose turns, and how many (``most`` at most); fewer if it has
    fewer. Returns the turns (as of ``turns``) and one row for each conversation with its new ``length``.
    """
    own = said.where("position = 0").select("conv_id", F.col("length").alias("own"), of.alias("of"), opening.cast("long").alias("h"))
    lengths = own.select(F.col("conv_id").alias("of"), F.col("own").alias("lent"))
    convs = own.join(lengths, "of", "left").select(
        "conv_id", "of", "h", F.least("h", F.coalesce("lent", F.lit(0))).alias("m"), F.greatest(F.col("own") - F.col("h"), F.lit(0)).alias("rest")
    )
    convs = stored(convs.withColumn("length", F.col("m") + F.col("rest")), "conversations")
    # A conversation's own turns meet its row once a segment, so that a huge one is spread.
    known = convs.where("rest > 0").select(
        F.col("conv_id").alias("c"), "h", "m", F.col("length").alias("total"), F.explode(F.sequence(F.lit(0), _segment(F.col("h") + F.col("rest") - 1))).alias("s")
    )
    cut = said.withColumn("s", _segment(F.col("position"))).drop("length")
    kept = cut.join(known, (F.col("conv_id") == F.col("c")) & (cut["s"] == known["s"])).where("position >= h")
    kept = kept.select("conv_id", (F.col("position") - F.col("h") + F.col("m")).alias("position"), "turn", "chars", F.col("total").alias("length"))
    lent = said.where(F.col("position") < most).select(F.col("conv_id").alias("of"), "position", "turn", "chars")
    opened = convs.join(lent, "of").where("position < h").select("conv_id", "position", "turn", "chars", "length")
    return kept.union(opened), convs.select("conv_id", "length")


def paths(said: DataFrame, convs: DataFrame) -> DataFrame:
    """Every node on the path of every conversation: digest, parent's digest, turn, depth, and if the conversation ends."""
    steps = said.select("conv_id", (F.col("position") + 1).alias("depth"), "turn", "chars", "length")
    lanes = {f"x{k}": F.xxhash64(F.lit(k), "depth", "turn") for k in (1, 2)}
    steps = steps.select("*", *[x.alias(n) for n, x in lanes.items()], _segment(F.col("depth")).alias("seg"))
    segments = steps.where(F.col("length") >= SEGMENT).groupBy(F.col("conv_id").alias("c"), F.col("seg").alias("s"))
    sums = segments.agg(*[F.bit_xor(n).alias(f"s{n}") for n in lanes])
    earlier = Window.partitionBy("c").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select("c", "s", *[F.coalesce(F.bit_xor(f"s{n}").over(earlier), F.lit(0)).alias(f"c{n}") for n in lanes])
    upto = Window.partitionBy("conv_id", "seg").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    inside = steps.select("*", *[F.bit_xor(n).over(upto).alias(f"i{n}") for n in lanes])
    joined = inside.join(carry, (F.col("conv_id") == F.col("c")) & (F.col("seg") == F.col("s")), "left")
    for k in (1, 2):
        joined = joined.withColumn(f"d{k}", F.col(f"ix{k}").bitwiseXOR(F.coalesce(f"cx{k}", F.lit(0))))
        joined = joined.withColumn(f"p{k}", F.col(f"d{k}").bitwiseXOR(F.col(f"x{k}")))
    columns = ["conv_id", "depth", "d1", "d2", "p1", "p2", "turn", "chars"]
    zero = F.lit(0).cast("long")
    root = convs.select(
        "conv_id", zero.alias("depth"), *[zero.alias(c) for c in ("d1", "d2", "p1", "p2")], F.lit(bytes(32)).alias("turn"), zero.alias("chars"), (F.col("length") == 0).alias("ends")
    )
    return joined.select(*columns, (F.col("depth") == F.col("length")).alias("ends")).union(root)


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table[n].combine_chunks().to_numpy(zero_copy_only=False) for n in names]


def _digests(table: pa.Table, *names: str) -> np.ndarray:
    return np.stack([c.view(np.uint64) for c in _columns(table, *names)], axis=1)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= SHARD_ROWS:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _count_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard in _shards(batches):
        digests = _digests(shard, "d1", "d2")
        nodes = SlotTable(digests)
        slots = nodes.slots(digests)
        first = nodes.first[slots]
        parents = _digests(shard, "p1", "p2")
        depth, chars, conv, ends = _columns(shard, "depth", "chars", "conv_id", "ends")
        turn = np.stack([np.frombuffer(b, dtype=np.uint64) for b in shard["turn"].to_pylist()])
        same = (parents == parents[first]).all(axis=1) & (turn == turn[first]).all(axis=1) & (depth == depth[first])
        if not same.all():
            raise ValueError("two prefixes share a digest")
        least = np.full(nodes.n, np.iinfo(np.int64).max)
        np.minimum.at(least, slots, conv)
        kept = shard.take(pa.array(nodes.first)).select(["d1", "d2", "p1", "p2", "turn", "depth", "chars"])
        counted = {
            "n": np.bincount(slots, minlength=nodes.n),
            "conv_id": least,
            "n_ends": np.bincount(slots[ends.astype(bool)], minlength=nodes.n),
        }
        for name, values in counted.items():
            kept = kept.append_column(name, pa.array(values.astype(np.int64)))
        yield from kept.combine_chunks().to_batches()


def nodes(on_paths: DataFrame) -> DataFrame:
    """One row for each node: digests, ``depth``, ``chars``, ``n_convs``, least member ``conv_id``, ``n_ends``."""
    partial = on_paths.mapInArrow(_count_shards, _PARTIAL)
    kept = F.struct("p1", "p2", "turn", "depth", "chars")
    grouped = partial.groupBy("d1", "d2").agg(
        F.min(kept).alias("a"), F.max(kept).alias("b"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("n_ends").alias("n_ends")
    )
    checked = grouped.withColumn("depth", F.when(F.col("a") == F.col("b"), F.col("a.depth")).otherwise(F.raise_error(F.lit("two prefixes share a digest")).cast("long")))
    return checked.select("d1", "d2", "a.p1", "a.p2", "depth", "a.chars", "n_convs", "conv_id", "n_ends")


def _values(of: DataFrame) -> DataFrame:
    """A node's own values at its least member, and what later segments of that member pass to the last turn of earlier ones."""
    own = of.select(
        "conv_id", "depth", F.when(F.col("n_ends") == F.col("n_convs"), 1).otherwise(0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("value")
    )
    later = own.where(F.col("depth") >= SEGMENT).groupBy("conv_id", _segment(F.col("depth")).alias("seg")).agg(F.sum("leaf").alias("leaf"), F.sum("value").alias("value"))
    group = Window.partitionBy("conv_id")
    down = group.orderBy(F.col("seg").desc()).rowsBetween(Window.unboundedPreceding, 0)
    since = later.select("conv_id", "seg", F.sum("leaf").over(down).alias("leaf"), F.sum("value").over(down).alias("value"), F.min("seg").over(group).alias("top"))
    start = F.when(F.col("seg") == F.col("top"), F.lit(0)).otherwise(F.col("seg") - 1)
    into = since.select("conv_id", F.explode(F.sequence(start, F.col("seg") - 1)).alias("into"), "leaf", "value")
    return own.union(into.select("conv_id", ((F.col("into") + 1) * SEGMENT - 1).alias("depth"), "leaf", "value"))


def _whole_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Shards that end where a segment of a conversation ends."""
    held: pa.Table | None = None
    for shard in _shards(batches):
        held = shard if held is None else pa.concat_tables([held, shard])
        conv, seg = _columns(held, "conv_id", "seg")
        last = int(np.flatnonzero((conv != conv[-1]) | (seg != seg[-1])).max(initial=-1)) + 1
        if last:
            yield held.slice(0, last)
            held = held.slice(last)
    if held is not None and held.num_rows:
        yield held


def _sum_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard in _whole_segments(batches):
        conv, seg, depth, on_path, leaf, value = _columns(shard, "conv_id", "seg", "depth", "on_path", "leaf", "value")
        path = on_path.astype(bool)
        row = np.cumsum(path) - 1  # values follow the path's row of their conversation and depth
        digests = _digests(shard, "d1", "d2")[path]
        table = SlotTable(digests)
        slots = table.slots(digests)
        totals = np.zeros((table.n, 2), dtype=np.int64)
        np.add.at(totals, slots[row[~path]], np.stack([leaf, value], axis=1)[~path])
        conv, seg, depth = conv[path], seg[path], depth[path]
        parent = np.full(table.n, -1, dtype=np.int64)
        below = np.flatnonzero((conv[1:] == conv[:-1]) & (seg[1:] == seg[:-1])) + 1
        parent[slots[below]] = slots[below - 1]
        level = depth[table.first]
        order = np.argsort(-level, kind="stable")
        for same in np.split(order, np.flatnonzero(np.diff(level[order])) + 1):
            same = same[parent[same] >= 0]
            np.add.at(totals, parent[same], totals[same])
        some = totals.any(axis=1)
        keys = table.keys[some].view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(c)) for c in (*keys.T, *totals[some].T)], names=["d1", "d2", "n_leaves", "saved"]
        )


def subtree_sums(on_paths: DataFrame, of: DataFrame) -> DataFrame:
    """``n_leaves``, ``saved`` and ``n_children`` of every node that has any."""
    zero = F.lit(0).cast("long")
    rows = on_paths.select("conv_id", "depth", F.lit(True).alias("on_path"), "d1", "d2", zero.alias("leaf"), zero.alias("value"))
    values = _values(of).select("conv_id", "depth", F.lit(False), zero, zero, "leaf", "value")
    both = rows.union(values).withColumn("seg", _segment(F.col("depth"))).repartition("conv_id", "seg")
    sums = both.sortWithinPartitions("conv_id", "depth", F.col("on_path").desc()).mapInArrow(_sum_shards, _SUMS)
    children = of.where("depth > 0").select(F.col("p1").alias("d1"), F.col("p2").alias("d2"), zero, zero, F.lit(1).cast("long"))
    every = sums.select("*", zero.alias("n_children")).union(children)
    return every.groupBy("d1", "d2").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), F.sum("n_children").alias("n_children"))


def _list_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard in _shards(batches):
        d1, d2, conv = _columns(shard, "d1", "d2", "conv_id")
        cut = np.flatnonzero((d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])) + 1
        bounds = [0, *cut.tolist(), len(conv)]
        spans = [(i, min(i + LISTED, b)) for a, b in zip(bounds, bounds[1:]) for i in range(a, b, LISTED)]
        names = conv.astype(str)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[[i for i, _ in spans]]) for x in (d1, d2, conv)] + [pa.array([",".join(names[i:j]) for i, j in spans], pa.string())],
            names=["d1", "d2", "first", "listed"],
        )


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state, done = None, hashlib.sha256(), []

    def rows() -> pa.RecordBatch:
        columns = list(zip(*done)) if done else [[], [], []]
        done.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["d1", "d2", "ends_sha256"]
        )

    for batch in batches:
        for d1, d2, listed in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("d1", "d2", "listed"))):
            if (d1, d2) == now:
                state.update(b",")
            else:
                if now is not None:
                    done.append((*now, state.hexdigest()))
                now, state = (d1, d2), hashlib.sha256()
            state.update(listed.encode())
        yield rows()
    if now is not None:
        done.append((*now, state.hexdigest()))
        yield rows()


def end_digests(on_paths: DataFrame) -> DataFrame:
    """SHA-256 of the ids of the conversations that end at a node, in order; nodes where none ends are left out."""
    ends = on_paths.where("ends").select("d1", "d2", "conv_id")
    ordered = ends.repartitionByRange("d1", "d2", "conv_id").sortWithinPartitions("d1", "d2", "conv_id")
    listed = ordered.mapInArrow(_list_members, "d1 long, d2 long, first long, listed string")
    dealt = listed.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "first")
    return dealt.mapInArrow(_hash_lists, "d1 long, d2 long, ends_sha256 string")


def trie(said: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations: ``said`` as of ``turns``, ``convs`` with ``conv_id`` and ``length``."""
    on_paths = stored(paths(said, convs), "paths")
    own = stored(nodes(on_paths), "nodes")
    whole = own.join(subtree_sums(on_paths, own), ["d1", "d2"], "left").join(end_digests(on_paths), ["d1", "d2"], "left")
    sums = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]
    none = F.lit(hashlib.sha256(b"").hexdigest())
    whole = stored(whole.select(*own.columns, *sums, F.coalesce("ends_sha256", none).alias("ends_sha256")), "trie")
    # Nodes with very many children are few: they meet their children by broadcast, all others by an exchange.
    parents = whole.where("n_children > 0").select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    many = F.col("n_children") > own.count() // HOT_NODES
    hot, others = (parents.where(c).drop("n_children") for c in (many, ~many))
    below = whole.where("depth > 0")
    met = below.join(F.broadcast(hot), ["p1", "p2"])
    rest = below.join(F.broadcast(hot.select("p1", "p2")), ["p1", "p2"], "left_anti").join(others, ["p1", "p2"])
    root = whole.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return root.select(columns).union(met.select(columns)).union(rest.select(columns))


def shared_openings(conversations: DataFrame, within: int = 100, most: int = 5) -> DataFrame:
    """Trie of conversations that start like the first of their block of ``within`` ids, for up to ``most`` turns."""
    said = stored(turns(conversations), "turns")
    conv = F.col("conv_id")
    return trie(*with_shared_openings(said, conv - conv % within, F.crc32(conv.cast("string").cast("binary")) % (most + 1), most))


SHARED_OPENINGS_SQL = """
WITH RECURSIVE t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS i,
         {'r': coalesce(role, ''), 't': coalesce(text, '')} AS said FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(said ORDER BY i) AS own FROM t GROUP BY conv_id),
bits AS (  -- CRC-32 of the decimal id, a byte at a time
  SELECT conv_id, CAST(4294967295 AS BIGINT) AS crc, 1 AS j, CAST(conv_id AS VARCHAR) AS s FROM c
  UNION ALL
  SELECT conv_id, list_reduce(list_prepend(xor(crc, CAST(ascii(s[j]) AS BIGINT)), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
           lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), j + 1, s
  FROM bits WHERE j <= len(s)),
h AS (SELECT conv_id, xor(crc, 4294967295) % 6 AS h FROM bits WHERE j > len(s)),
p AS (SELECT c.conv_id, list_concat(coalesce(b.own, [])[1:h], c.own[h + 1:]) AS turns
      FROM c JOIN h USING (conv_id) LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 100),
r AS (SELECT conv_id, len(turns) AS n, d, turns[1:d] AS k, CASE WHEN d > 0 THEN turns[1:d - 1] END AS pk,
             CASE WHEN d > 0 THEN length(turns[d].t) ELSE 0 END AS chars
      FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM p)),
n AS (SELECT k, d, any_value(pk) AS pk, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
             count(*) FILTER (n = d) AS n_ends,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends FROM r GROUP BY k, d),
own AS (SELECT conv_id, d, CASE WHEN n_ends = n_convs THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * chars AS value FROM n),
s AS (SELECT a.k, sum(leaf) AS n_leaves, sum(value) AS saved
      FROM own JOIN r a ON own.conv_id = a.conv_id AND a.d <= own.d GROUP BY a.k),
kids AS (SELECT pk, count(*) AS n_children FROM n WHERE d > 0 GROUP BY pk)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN s ON s.k = n.k LEFT JOIN kids ON kids.pk = n.k LEFT JOIN n u ON n.d > 0 AND u.k = n.pk
"""
