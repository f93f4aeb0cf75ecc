"""Virtual potential temperature and bulk Richardson number of gridded columns.

Cell tables carry ``p t qv u v hhl hsurf`` and a vertical position ``z`` whose last value is the reference level.
``brn`` pairs the number of levels from ``z`` to the last one with the theta sum over the last ``z + 1`` levels;
``aligned=True`` uses the sum over the levels from ``z`` to the last one instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.functions import physics as phys
from gridspark.operators.ranks import across_segments, cut, last, number_of_rows, with_group_stats
from gridspark.operators.rounds import rounds
from gridspark.session import materialize, remove, scratch_path, store

THETAV_INPUTS = ("p", "t", "qv")
BRN_INPUTS = ("p", "t", "qv", "u", "v", "hhl", "hsurf")


def _theta() -> Column:
    return phys.thetav(*[F.col(c) for c in THETAV_INPUTS])


def _wind() -> Column:
    return phys.wind_sq(F.col("u"), F.col("v"))


# ---------------------------------------------------------------- theta


def thetav(cells: DataFrame, dims: Sequence[str], name: str = "thetav") -> DataFrame:
    """One narrow projection."""
    return cells.select(*dims, _theta().alias(name))


def _block_thetav(p: np.ndarray, t: np.ndarray, qv: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        moisture = 1.0 + phys.VAPOUR_FACTOR * qv / (1.0 - qv)
        return np.power(phys.P_SURFACE / p, phys.KAPPA) * t * moisture


def thetav_arrow(cells: DataFrame, dims: Sequence[str], name: str = "thetav") -> DataFrame:
    """The same on Arrow batches in Python workers; no shuffle."""
    inputs = cells.select(*dims, *THETAV_INPUTS)
    schema = T.StructType([*[inputs.schema[d] for d in dims], T.StructField(name, T.DoubleType())])
    keep = len(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = _block_thetav(*[b.column(c).to_numpy(zero_copy_only=False) for c in THETAV_INPUTS])
            names = [*b.schema.names[:keep], name]
            yield pa.RecordBatch.from_arrays([*b.columns[:keep], pa.array(values)], names=names)

    return inputs.mapInArrow(run, schema)


# ---------------------------------------------------------------- parts of the Richardson number


def level_count(cells: DataFrame, keys: Sequence[str], name: str = "levels") -> DataFrame:
    """Number of levels from ``z`` to the last one."""
    counted = with_group_stats(cells.select(*keys, "z"), keys, "z", {"_n": number_of_rows()})
    return counted.select(*keys, "z", (F.col("_n") - F.col("z")).cast("bigint").alias(name))


def last_level_anomaly(cells: DataFrame, variable: Column, keys: Sequence[str], name: str = "anomaly") -> DataFrame:
    """Difference from the value at the last level of the column."""
    values = cells.select(*keys, "z", variable.alias("_v"))
    joined = with_group_stats(values, keys, "z", {"_last": last(F.col("_v"), "z")})
    return joined.select(*keys, "z", (F.col("_v") - F.col("_last")).alias(name))


def wind_and_height(cells: DataFrame, dims: Sequence[str]) -> DataFrame:
    return cells.select(*dims, _wind().alias("wind_sq"), (F.col("hhl") - F.col("hsurf")).alias("height"))


def _with_carry(values: DataFrame, keys: Sequence[str], segment: int | None) -> DataFrame:
    """Cells with the sum of ``_v`` over later segments of their column (``_carry``), its depth ``_n`` and its last value
    ``_last``. Only one row per segment crosses segments."""
    column = Window.partitionBy("_k2")
    after = column.orderBy("_seg2").rowsBetween(1, Window.unboundedFollowing)
    return across_segments(
        cut(values, keys, "z", segment),
        {"_sum": F.sum("_v"), "_c": F.count(F.lit(1)), "_top": F.max_by("_v", "z")},
        {
            "_carry": F.coalesce(F.sum("_sum").over(after), F.lit(0.0)),
            "_n": F.sum("_c").over(column),
            "_last": F.max_by("_top", "_seg2").over(column),
        },
    )


def _window_sums(cells: DataFrame) -> DataFrame:
    """Cells with ``_suffix``, the sum of ``_v`` from the cell to the last level, by a window inside the segment."""
    inside = Window.partitionBy("_k", "_seg").orderBy(F.desc("z")).rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("_suffix", F.sum("_v").over(inside) + F.col("_carry"))


def vertical_cumsum_rev(
    cells: DataFrame, variable: Column, keys: Sequence[str], name: str = "cumsum", segment: int | None = None
) -> DataFrame:
    """Flip, accumulate, keep the flipped order: level ``k`` holds the sum of the last ``k + 1`` levels.

    Emitting each suffix sum under its mirrored position needs no join back.
    """
    sums = _window_sums(_with_carry(cells.select(*keys, "z", variable.alias("_v")), keys, segment))
    return sums.select(*keys, (F.col("_n") - 1 - F.col("z")).cast("bigint").alias("z"), F.col("_suffix").alias(name))


# ---------------------------------------------------------------- bulk Richardson number


def _brn_parts(cells: DataFrame, keys: Sequence[str], carry: Sequence[str]) -> DataFrame:
    height = F.col("hhl") - F.col("hsurf")
    return cells.select(*keys, "z", _theta().alias("_v"), height.alias("_h"), _wind().alias("_w"), *carry)


def _brn_value() -> Column:
    anomaly, levels = F.col("_v") - F.col("_last"), F.col("_n") - F.col("z")
    return phys.richardson(F.col("_h"), anomaly, levels, F.col("_s"), F.col("_w")).alias("brn")


def _brn_of_sums(summed: DataFrame, keys: Sequence[str], aligned: bool, carry: Sequence[str]) -> DataFrame:
    """The mirrored sum comes from a window over the pair of levels ``z`` and ``n - 1 - z``, two rows each."""
    if aligned:
        picked = summed.withColumn("_s", F.col("_suffix"))
    else:
        paired = summed.withColumn("_pair", F.least(F.col("z"), F.col("_n") - 1 - F.col("z")))
        pair = Window.partitionBy("_k", "_pair").orderBy("z")
        mirrored = F.coalesce(F.lead("_suffix").over(pair), F.lag("_suffix").over(pair), F.col("_suffix"))
        picked = paired.withColumn("_s", mirrored)
    return picked.select(*keys, "z", *carry, _brn_value())


def brn_segmented(
    cells: DataFrame,
    keys: Sequence[str],
    aligned: bool = False,
    carry: Sequence[str] = (),
    segment: int | None = None,
) -> DataFrame:
    """Windows inside segments of a column; columns named in ``carry`` are passed through.

    Cells are exchanged twice, by segment and by pair of mirrored levels, for columns of any depth.
    """
    sums = _window_sums(_with_carry(_brn_parts(cells, keys, carry), keys, segment))
    return _brn_of_sums(sums, keys, aligned, carry)


def to_profiles(cells: DataFrame, keys: Sequence[str], variables: Sequence[str], surface: Sequence[str] = ()) -> DataFrame:
    """Profile layout: one row per column, each variable an array over ``z``."""
    levels = F.array_sort(F.collect_list(F.struct("z", *variables))).alias("_levels")
    flat = [F.first(s).alias(s) for s in surface]
    rows = cells.groupBy(*keys).agg(levels, *flat)
    return rows.select(*keys, *[F.col(f"_levels.{v}").alias(v) for v in variables], *surface)


def from_profiles(profiles: DataFrame, keys: Sequence[str], variable: str) -> DataFrame:
    """Back to one row per cell. The outer form keeps the planner from adding a filter that would compute the
    array a second time; columns are never empty."""
    rows = profiles.select(*keys, F.posexplode_outer(variable).alias("z", variable))
    return rows.withColumn("z", F.col("z").cast("bigint"))


def _reverse_cumsum(values: Column) -> Column:
    """Running sums over the reversed array."""
    start = F.struct(F.lit(0.0).alias("total"), F.array().cast("array<double>").alias("sums"))

    def step(acc: Column, x: Column) -> Column:
        total = acc["total"] + x
        return F.struct(total.alias("total"), F.concat(acc["sums"], F.array(total)).alias("sums"))

    return F.aggregate(F.reverse(values), start, step, lambda acc: acc["sums"])


def brn_of_profiles(profiles: DataFrame, carry: Sequence[str], aligned: bool = False) -> DataFrame:
    """One narrow projection per row of the profile layout (arrays ``p t qv u v hhl``, scalar ``hsurf``)."""
    cell = F.arrays_zip("p", "t", "qv", "u", "v", "hhl")
    with_theta = profiles.withColumn("_theta", F.transform(cell, lambda c: phys.thetav(c["p"], c["t"], c["qv"])))
    sums = _reverse_cumsum(F.col("_theta"))
    with_sums = with_theta.withColumn("_sums", F.reverse(sums) if aligned else sums)
    n = F.size("_theta")

    def at_level(c: Column, i: Column) -> Column:
        return phys.richardson(
            c["hhl"] - F.col("hsurf"),
            c["_theta"] - F.element_at("_theta", -1),
            n - i,
            c["_sums"],
            phys.wind_sq(c["u"], c["v"]),
        )

    zipped = F.arrays_zip("u", "v", "hhl", "_theta", "_sums")
    return with_sums.select(*carry, F.transform(zipped, at_level).alias("brn"))


def brn_profile(
    cells: DataFrame, keys: Sequence[str], aligned: bool = False, carry: Sequence[str] = ()
) -> DataFrame:
    """Running sums by array functions: the levels of a segment make a short profile."""
    carried = _with_carry(_brn_parts(cells, keys, carry), keys, None)
    rest = [c for c in carried.columns if c not in ("_k", "_seg", "_carry", "_n", "_last", "z")]
    levels = F.array_sort(F.collect_list(F.struct("z", *rest))).alias("_levels")
    held = carried.groupBy("_k", "_seg").agg(levels, *[F.first(c).alias(c) for c in ("_carry", "_n", "_last")])
    sums = F.reverse(_reverse_cumsum(F.transform("_levels", lambda e: e["_v"])))
    each = held.select("_k", "_carry", "_n", "_last", F.explode(F.arrays_zip(F.col("_levels"), sums.alias("_run"))).alias("_e"))
    summed = each.select("_k", "_n", "_last", "_e._levels.*", (F.col("_e._run") + F.col("_carry")).alias("_suffix"))
    return _brn_of_sums(summed, keys, aligned, carry)


def brn_windows(
    cells: DataFrame, keys: Sequence[str], aligned: bool = False, carry: Sequence[str] = ()
) -> DataFrame:
    """The default form: :func:`brn_segmented` with segments of the usual size."""
    return brn_segmented(cells, keys, aligned, carry)


def _segment_sums(starts: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Sum from each row to the end of its segment, for segments laid end to end; one pass per level of the deepest."""
    sizes = np.diff(np.append(starts, len(theta)))
    sums = np.empty_like(theta)
    order = np.argsort(-sizes, kind="stable")
    total = np.zeros(len(sizes))
    ends = starts + sizes - 1
    for k in range(int(sizes.max(initial=0))):
        alive = order[: np.searchsorted(-sizes[order], -k, side="left")]
        total[alive] += theta[ends[alive] - k]
        sums[ends[alive] - k] = total[alive]
    return sums


def brn_arrow(
    cells: DataFrame, keys: Sequence[str], aligned: bool = False, carry: Sequence[str] = ()
) -> DataFrame:
    """Arrow batches of the segments' rows in order: many segments are summed per NumPy call."""
    inside = Window.partitionBy("_k", "_seg").orderBy("z")
    held = _with_carry(_brn_parts(cells, keys, carry), keys, None)
    inputs = held.withColumn("_i", F.row_number().over(inside) - 1).drop("_seg")
    schema = T.StructType([*inputs.schema.fields, T.StructField("_suffix", T.DoubleType())])

    def compute(table: pa.RecordBatch) -> pa.RecordBatch:
        position, theta, later = (table.column(c).to_numpy(zero_copy_only=False) for c in ("_i", "_v", "_carry"))
        with np.errstate(all="ignore"):
            sums = _segment_sums(np.flatnonzero(position == 0), theta) + later
        return pa.RecordBatch.from_arrays([*table.columns, pa.array(sums)], names=[*table.schema.names, "_suffix"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []  # a segment that continues in the next batch
        for b in batches:
            tops = np.flatnonzero(b.column("_i").to_numpy(zero_copy_only=False) == 0)
            if len(tops) == 0:
                rest.append(b)
                continue
            cut = int(tops[-1])
            done = [*rest, b.slice(0, cut)] if cut else rest
            if done:
                yield compute(pa.concat_batches(done))
            rest = [b.slice(cut)]
        if rest:
            yield compute(pa.concat_batches(rest))

    return _brn_of_sums(inputs.mapInArrow(run, schema), keys, aligned, carry)


#: Default implementation and all variants by name.
THETAV_VARIANTS: dict[str, Callable] = {"thetav_expr": thetav, "thetav_arrow": thetav_arrow}
BRN_VARIANTS: dict[str, Callable] = {
    "brn_profile": brn_profile,
    "brn_windows": brn_windows,
    "brn_arrow": brn_arrow,
    "brn_segmented": brn_segmented,
}
brn = brn_windows


# ---------------------------------------------------------------- iteration


def iterate(df: DataFrame, step: Callable[[DataFrame], DataFrame], n: int, cut_every: int = 4) -> DataFrame:
    """Apply ``step`` ``n`` times. Every ``cut_every`` steps the state is written out, which keeps plans short and
    leaves a restart point that survives lost executors."""
    for i in range(1, n + 1):
        df = step(df)
        if i % cut_every == 0 and i < n:
            df = materialize(df, "iterate")
    return df


def iterate_thetav(cells: DataFrame, dims: Sequence[str], n: int, carry: str = "t") -> DataFrame:
    """``n`` rounds of theta with its output carried into variable ``carry``."""
    state = cells.select(*dims, *THETAV_INPUTS)
    out = iterate(state, lambda df: df.withColumn(carry, _theta()), n)
    return out.select(*dims, F.col(carry).alias("thetav"))


def repeated_brn(cells: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """``n`` rounds of the Richardson number, each round's output being the next round's pressure.

    The other inputs ride along. Each round reads its cells twice, so its input is written out, until the next one is.
    Large tables go through all rounds in parts of whole columns; only the results of all parts are kept.
    """
    spark, others = cells.sparkSession, BRN_INPUTS[1:]

    def step(state: DataFrame) -> DataFrame:
        return brn(state, keys, carry=others).withColumnRenamed("brn", "p")

    out = scratch_path(spark, "repeated")
    for part in rounds(cells.select(*keys, "z", *BRN_INPUTS), keys):
        state, held = part, None
        for _ in range(n - 1):
            path = scratch_path(spark, "repeat")
            store(step(state), path)
            if held:
                remove(spark, held)
            state, held = spark.read.parquet(path), path
        last_round = brn(state, keys)
        store(last_round, out, "append")
        if held:
            remove(spark, held)
    return spark.read.schema(last_round.schema).parquet(out)


def repeated_brn_of_profiles(profiles: DataFrame, carry: Sequence[str], n: int) -> DataFrame:
    """The same in profile layout: every round is a narrow projection."""
    fixed = ["t", "qv", "u", "v", "hhl", "hsurf"]
    out = iterate(
        profiles,
        lambda df: brn_of_profiles(df, [*carry, *fixed]).withColumnRenamed("brn", "p"),
        n,
    )
    return out.select(*carry, F.col("p").alias("brn"))
