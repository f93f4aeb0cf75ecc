"""Alignment of variables on shared dimensions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.functions.ieee import NAN
from gridspark.operators import ranks


def merge_fields(frames: Sequence[DataFrame], dims: Sequence[str]) -> DataFrame:
    """Outer alignment of variables on ``dims``; positions a variable lacks become NaN.

    Cell positions are unique per frame, so the join keys carry no skew.
    """
    dims = list(dims)
    merged = reduce(lambda a, b: a.join(b, dims, "full_outer"), frames)
    variables = [c for c in merged.columns if c not in dims]
    return merged.select(*dims, *[F.coalesce(c, F.lit(NAN)).alias(c) for c in variables])


def with_surface(cells: DataFrame, surface: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach lower-dimensional variables to every level of their column.

    No broadcast hint: the surface grows with the grid, so the planner decides by size, and the adaptive skew join
    splits the cells of a deep column. Columns without a surface row, or with a null key, have no match.
    """
    return cells.join(surface, list(keys))


def align_fields(a: DataFrame, b: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Cells present in both frames, for element-wise arithmetic."""
    return a.join(b, list(dims))


def coordinate_index(cells: DataFrame, dim: str, label: str) -> DataFrame:
    """The labels along ``dim``, one row each with the position; a label at two positions is an error. Null is no label."""
    at = cells.where(F.col(label).isNotNull()).groupBy(label).agg(F.min(dim).alias("_low"), F.max(dim).alias("_high"))
    message = F.concat(F.lit(f"several positions of {dim} are labelled "), F.col(label).cast("string"))
    once = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(F.raise_error(message).cast("bigint"))
    return at.select(label, once.alias(dim))


def align_labels(a: DataFrame, b: DataFrame, dims: Sequence[str], labels: Mapping[str, str]) -> DataFrame:
    """Cells present in both frames, for element-wise arithmetic, matched by label where a dimension has labels.

    ``labels`` names the column, in both frames, that labels a dimension; the other dimensions are matched by position.
    Positions along a labelled dimension are derived: the labels that both frames have, in the order of the first.

    Cells are joined on labels and positions, so they move once; the indexes have a row per label, and their rows are ranked
    in segments.
    """
    keys = [labels.get(d, d) for d in dims]
    variables = [[c for c in f.columns if c not in (*dims, *keys)] for f in (a, b)]
    twice = set(variables[0]) & set(variables[1])
    if twice:
        raise ValueError(f"given twice: {sorted(twice)}")
    out = a.select(*keys, *variables[0]).join(b.select(*keys, *variables[1]), keys)
    for dim, label in labels.items():
        both = coordinate_index(a, dim, label).join(coordinate_index(b, dim, label).select(label, F.col(dim).alias("_other")), label)
        segment = F.floor(F.col(dim) / ranks.SEGMENT)
        # the other position is kept in the plan, so that its check is too
        ranked = ranks.with_positions(both.withColumn("_all", F.lit(0)), ["_all"], [dim, "_other"], "_place", coarse=[segment])
        out = out.join(ranked.select(label, F.col("_place").alias(dim)), label)
    named = [label for label in labels.values() if label not in dims]
    return out.select(*dims, *named, *variables[0], *variables[1])


@dataclass
class Dataset:
    """Variables of different dimensions: one table for each set of dimensions.

    Tables hold what was given; a position that a table lacks is NaN in all its variables. No variable is repeated along a
    dimension that it does not have.
    """

    dims: tuple[str, ...]
    tables: dict[frozenset[str], DataFrame]

    def dims_of(self, variable: str) -> frozenset[str]:
        return next(own for own, table in self.tables.items() if variable in table.columns and variable not in own)

    def coordinate(self, dim: str) -> DataFrame:
        """The positions along ``dim`` that any variable has, one row each."""
        having = [t.select(dim).distinct() for own, t in self.tables.items() if dim in own]
        return reduce(DataFrame.union, having).distinct()

    def along(self, dim: str) -> DataFrame:
        """The variables that have this one dimension alone, at every position of the coordinate."""
        own = frozenset([dim])
        if own not in self.tables:
            return self.coordinate(dim)
        return _gaps_filled(self.coordinate(dim).join(self.tables[own], [dim], "left"), own)

    def cells(self, variables: Sequence[str]) -> DataFrame:
        """The named variables at every position that one of those with most dimensions has.

        Tables of fewer dimensions meet the cells on the dimensions they have. A single value, without dimensions, is a
        scalar of the plan.
        """
        used = sorted({self.dims_of(v) for v in variables}, key=lambda own: (-len(own), sorted(own)))
        full = frozenset().union(*used)
        if used[0] != full:
            raise ValueError(f"no variable has all of the dimensions {sorted(full)}")
        out = self.tables[used[0]].select(*self._ordered(full), *self._of(used[0], variables))
        for own in used[1:]:
            named = self._of(own, variables)
            if own:
                out = out.join(self.tables[own].select(*self._ordered(own), *named), self._ordered(own), "left")
            else:
                out = out.withColumns({v: self.tables[own].select(F.max(v)).scalar() for v in named})
        return _gaps_filled(out.select(*self._ordered(full), *variables), full)

    def _ordered(self, own: Iterable[str]) -> list[str]:
        return [d for d in self.dims if d in own]

    def _of(self, own: frozenset[str], variables: Sequence[str]) -> list[str]:
        return [v for v in variables if self.dims_of(v) == own]


def _gaps_filled(table: DataFrame, dims: Iterable[str]) -> DataFrame:
    numbers = [c for c, kind in table.dtypes if c not in dims and kind in ("double", "float")]
    return table.withColumns({c: F.coalesce(c, F.lit(NAN).cast(table.schema[c].dataType)) for c in numbers})


def merge_dataset(frames: Sequence[DataFrame], dims: Sequence[str]) -> Dataset:
    """Merge variables of any dimensions among ``dims``: what a frame has of them are its dimensions, the rest variables.

    Frames with the same dimensions are aligned with each other by an outer join; the others stay tables of their own.
    """
    found: dict[frozenset[str], list[DataFrame]] = {}
    names: set[str] = set()
    for frame in frames:
        own = frozenset(c for c in frame.columns if c in dims)
        given = set(frame.columns) - own
        if given & names:
            raise ValueError(f"given twice: {sorted(given & names)}")
        names |= given
        found.setdefault(own, []).append(frame)
    order = [d for d in dims if any(d in own for own in found)]
    if len(found.get(frozenset(), [])) > 1:
        raise ValueError("give all values without dimensions in one frame")
    tables = {own: merge_fields(some, [d for d in order if d in own]) if len(some) > 1 else some[0] for own, some in found.items()}
    return Dataset(tuple(order), tables)
