"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A document of a source is copied ``target / source_size`` times on average: the whole part is certain, the fraction is
its copy probability. Two documents at a time transfer mass, one way or the other at random so that expectations hold,
until one probability is 0 or 1. Mass is measured in words, so the words a source takes stay at the target. Blocks of
documents fold to one undecided document each; these residuals are blocked again, level by level: a reduction tree that
ends in one residual per source, which is rounded to the nearer integer: a source misses its target by half a document at
most. Random numbers are hashes of ids, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridspark.llm.tables import stored

# Fixed values of the task: weights by the order of the sources, and how often a source may be repeated.
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Documents that fold to one residual, about.
BLOCK = 32

_UNIT = "struct<key:binary,size:bigint,p:double>"


def sized(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``source`` and ``size``, the number of blank-separated words of the whole text (null: 0)."""
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    return documents.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(words, F.lit(0)).cast("long").alias("size"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``source``, ``source_size`` and ``target`` of each source, from its ``source`` and ``source_size``.

    Sources in code point order (null last) take the weights in turn and share the sum of all sizes. No target exceeds
    ``most`` times its source's size; the excess goes to the others by weight. That settles at ``least(rate * weight,
    most * size)``: in the order of ``most * size / weight`` the first sources are capped, up to the first whose share of
    what is left fits. The table has one row for each source, so its windows are small.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy((F.col("room") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, whole = by_room.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    place = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int"))).withColumn(
        "room", F.col("source_size") * most
    )
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("room").over(before), F.lit(0))
    weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    shared = ranked.withColumn("rate", left / weight)
    fits = F.when(F.col("rate") * F.col("weight") <= F.col("room"), F.col("rate"))
    rate = F.coalesce(F.max(fits).over(whole), F.max("rate").over(whole))
    return shared.withColumn("rate", rate).select(
        "source", "source_size", F.least(F.col("rate") * F.col("weight"), F.col("room").cast("double")).alias("target")
    )


def _random(*parts: Column) -> Column:
    """Uniform in [0, 1) from the hash of its parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def _transfer(state: Column, unit: Column) -> Column:
    """Fold one more unit into (open, done): at most one of the two stays open, the other is decided."""
    mine, other = state["open"], unit
    a, b, p, q = mine["size"], other["size"], mine["p"], other["p"]
    gain = F.least(a * (1 - p), b * q)  # words that may move from other to mine
    loss = F.least(a * p, b * (1 - q))
    up = _random(mine["key"], other["key"]) * (gain + loss) < loss
    p_full, q_empty = a * (1 - p) <= b * q, a * (1 - p) >= b * q
    p_empty, q_full = a * p <= b * (1 - q), a * p >= b * (1 - q)
    new_p = F.when(up, F.when(p_full, 1.0).otherwise(p + gain / a)).otherwise(F.when(p_empty, 0.0).otherwise(p - loss / a))
    new_q = F.when(up, F.when(q_empty, 0.0).otherwise(q - gain / b)).otherwise(F.when(q_full, 1.0).otherwise(q + loss / b))
    made = F.struct(new_p.alias("p"), new_q.alias("q"))
    return F.when(mine["key"].isNull(), F.struct(other.alias("open"), state["done"].alias("done"))).otherwise(
        F.element_at(F.transform(F.array(made), lambda m: _decided(state, other, m)), 1)
    )


def _decided(state: Column, other: Column, made: Column) -> Column:
    mine = state["open"]
    first = F.struct(mine["key"].alias("key"), mine["size"].alias("size"), made["p"].alias("p"))
    second = F.struct(other["key"].alias("key"), other["size"].alias("size"), made["q"].alias("p"))
    first_done, second_done = made["p"].isin(0.0, 1.0), made["q"].isin(0.0, 1.0)
    none = F.lit(None).cast(_UNIT)
    open_one = F.when(first_done & second_done, none).when(first_done, second).otherwise(first)
    done = F.when(first_done & second_done, F.array(first, second)).when(first_done, F.array(first)).otherwise(F.array(second))
    return F.struct(open_one.alias("open"), F.concat(state["done"], done).alias("done"))


def _level(units: DataFrame, blocks: Column) -> DataFrame:
    """Fold each block of a source; rows are the decided units and one open unit for each block (``open`` true).

    Large documents go first, so that what stays open, and with it the last residual, tends to be small.
    """
    start = F.struct(F.lit(None).cast(_UNIT).alias("open"), F.array().cast(f"array<{_UNIT}>").alias("done"))
    folded = (
        units.groupBy("source", blocks.alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("less"), "key", "size", "p"))).alias("units"))
        .select("source", "block", F.aggregate("units", start, lambda s, u: _transfer(s, u.dropFields("less"))).alias("s"))
    )
    rows = F.concat(
        F.transform("s.done", lambda u: F.struct(u.alias("unit"), F.lit(False).alias("open"))),
        F.when(F.col("s.open").isNull(), F.array().cast(f"array<struct<unit:{_UNIT},open:boolean>>")).otherwise(
            F.array(F.struct(F.col("s.open").alias("unit"), F.lit(True).alias("open")))
        ),
    )
    return folded.select("source", "block", F.explode(rows).alias("r")).select("source", "block", "r.unit.*", "r.open")


def round_copies(units: DataFrame, count: int) -> DataFrame:
    """Decide every unit of (``source``, ``key``, ``size`` > 0, ``p`` strictly between 0 and 1) to 0 or 1.

    ``key`` is a binary id, unique within a source. ``count`` bounds the units of a source; it sets the height of the
    tree. Result: ``source``, ``key`` and ``extra``. Each level is written to the shared folder.
    """
    blocks = max(1, -(-count // BLOCK))
    decided = []
    level = stored(_level(units, F.pmod(F.xxhash64(F.lit(5), "key"), F.lit(blocks))), "mix")
    while True:
        decided.append(level.where(~F.col("open")))
        residuals = level.where("open")
        if blocks == 1:
            break
        blocks = -(-blocks // BLOCK)
        level = stored(_level(residuals, F.floor(F.col("block") / BLOCK)), "mix")
    last = residuals.withColumn("p", (F.col("p") >= 0.5).cast("double"))
    out = last
    for part in decided:
        out = out.unionByName(part)
    return out.select("source", "key", F.col("p").cast("int").alias("extra"))


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """For every row: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``copies`` and ``taken``.

    ``taken`` is ``copies * size``. Documents without words are never copied, and if all sizes are 0 so are the targets.
    Repeated rows (equal id, source and size; null ids too) are one unit whose copies are dealt to its rows in turn.
    """
    rows = stored(sized(documents).groupBy("source", "doc_id", "size").agg(F.count("*").alias("rows")), "mix-sizes")
    totals = rows.groupBy("source").agg(
        F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("units")
    )
    totals = stored(totals, "mix-totals")
    shares = stored(targets(totals.select("source", "source_size"), weights, most), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    named = shares.withColumnRenamed("source", "of").withColumn("rate", rate)
    mass = F.when(F.col("size") > 0, F.col("rows") * (F.col("rate") - F.floor("rate"))).otherwise(0.0)
    # concat_ws leaves a null id out, so its key has no bar and differs from those of all other ids
    key = F.encode(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("size").cast("string")), "utf-8")
    units = (
        rows.join(named, rows["source"].eqNullSafe(named["of"]))
        .drop("of")
        .withColumn("sure", F.floor(mass))
        .withColumn("p", mass - F.floor(mass))
        .withColumn("key", key)
    )
    units = stored(units, "mix-units")
    count = totals.agg(F.max("units")).first()[0] or 0
    rounded = round_copies(units.where((F.col("p") > 0) & (F.col("p") < 1)).select("source", "key", "size", "p"), count)
    rounded = rounded.select(F.col("source").alias("of"), F.col("key").alias("unit"), "extra")
    found = units.join(rounded, units["source"].eqNullSafe(rounded["of"]) & (units["key"] == rounded["unit"]), "left")
    extra = F.col("sure") + F.coalesce("extra", F.lit(0))
    each = F.when(F.col("size") > 0, F.floor("rate")).otherwise(0)
    return (
        found.withColumn("extra", extra)
        .withColumn("i", F.explode(F.sequence(F.lit(1), F.col("rows"))))
        .withColumn("copies", (each + F.when(F.col("i") <= F.col("extra"), 1).otherwise(0)).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )
