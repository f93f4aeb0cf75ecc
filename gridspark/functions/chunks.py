"""Arithmetic on chunk specifications.

A specification of one dimension is a bigint column (size of every chunk but the last; ``-1`` is a single chunk;
null is "no preference") or an array column with the explicit sizes. Everything here is row-local, so comparing
many layouts is one narrow projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What "auto" stands for unless the caller says otherwise: one chunk.
AUTO_CHUNK = -1


def parse_spec(spec: Column, auto: int = AUTO_CHUNK) -> Column:
    """Textual specification to a number, resolving ``auto``."""
    return F.when(spec == "auto", F.lit(auto).cast("bigint")).otherwise(spec.try_cast("bigint"))


def simplify_map(specs: Column, auto: int = AUTO_CHUNK) -> Column:
    """Map form: drop entries without preference, resolve ``auto``."""
    kept = F.map_filter(specs, lambda _, v: v.isNotNull())
    return F.transform_values(kept, lambda _, v: F.when(v == "auto", F.lit(auto)).otherwise(v.cast("bigint")))


def chunk_count(spec: Column, dim_size: Column) -> Column:
    return F.when(spec == -1, F.lit(1)).otherwise(F.ceil(dim_size / spec)).cast("bigint")


def chunk_sizes(spec: Column, dim_size: Column) -> Column:
    """Explicit sizes for a single chunk size, the remainder last."""
    step = F.when(spec == -1, dim_size).otherwise(spec).cast("bigint")
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(dim_size - 1, F.lit(0)).cast("bigint"), step)
    return F.transform(starts, lambda s: F.least(step, dim_size - s))


def boundaries(sizes: Column) -> Column:
    """Chunk ends of an explicit size list; lists have one entry per chunk of one dimension."""
    start = F.array().cast("array<bigint>")

    def add(ends: Column, size: Column) -> Column:
        return F.array_append(ends, F.coalesce(F.try_element_at(ends, F.lit(-1)), F.lit(0).cast("bigint")) + size)

    return F.aggregate(sizes, start, add)


def specs_equal(spec1: Column, spec2: Column, dim_size: Column) -> Column:
    """Whether two single-number specifications give the same chunks; no preference matches anything."""
    step1 = F.when((spec1 == -1) | (spec1 > dim_size), dim_size).otherwise(spec1)
    step2 = F.when((spec2 == -1) | (spec2 > dim_size), dim_size).otherwise(spec2)
    return spec1.isNull() | spec2.isNull() | (step1 == step2)


def sizes_of_text(text: Column, dim_size: Column) -> Column:
    """Explicit sizes of a textual specification, a number or a list."""
    listed = F.transform(F.split(text, ","), lambda n: n.cast("bigint"))
    return F.when(F.size(listed) == 1, chunk_sizes(F.get(listed, F.lit(0)), dim_size)).otherwise(listed)


def texts_equal(spec1: Column, spec2: Column, dim_size: Column) -> Column:
    """:func:`specs_equal` for textual specifications; ``auto`` is no preference here."""
    undecided = spec1.isNull() | spec2.isNull() | (spec1 == "auto") | (spec2 == "auto")
    numbers = [F.when(s != "auto", s) for s in (spec1, spec2)]
    same = sizes_of_text(numbers[0], dim_size) == sizes_of_text(numbers[1], dim_size)
    return undecided | F.coalesce(same, F.lit(False))


def no_split(spec1: Column, spec2: Column) -> Column:
    """Whether chunks of size ``spec1`` can be merged into chunks of size ``spec2`` without splitting any."""
    return (
        F.when(spec1.isNull() | spec2.isNull() | (spec2 == -1), F.lit(True))
        .when(spec1 == -1, F.lit(False))
        .otherwise((spec1 <= spec2) & (spec2 % spec1 == 0))
    )


def no_split_lists(sizes1: Column, sizes2: Column) -> Column:
    """List form: every end of a target chunk is an end of a source chunk, and the totals agree."""
    ends1, ends2 = boundaries(sizes1), boundaries(sizes2)
    same_total = F.try_element_at(ends1, F.lit(-1)) == F.try_element_at(ends2, F.lit(-1))
    return same_total & (F.size(F.array_except(ends2, ends1)) == 0)


def spec_ends(text: str) -> str:
    """SQL for a textual specification as an array: a number as itself, an explicit list (``10,20,30``) as its chunk
    ends. Written as text because it is used inside lambdas over many specifications."""
    sizes = f"transform(split({text}, ','), n -> bigint(n))"
    return f"aggregate({sizes}, cast(array() AS array<bigint>), (e, n) -> array_append(e, n + coalesce(array_max(e), 0)))"


def ends_merge(ends1: str, ends2: str) -> str:
    """SQL for :func:`no_split` on the arrays of :func:`spec_ends`, where a single entry is a number.

    Next to a list a number stands for equal chunks of the list's total, whose inner ends are its multiples.
    """
    first1, first2 = f"get({ends1}, 0)", f"get({ends2}, 0)"
    total1, total2 = f"get({ends1}, size({ends1}) - 1)", f"get({ends2}, size({ends2}) - 1)"
    return f"""CASE
        WHEN {ends1} IS NULL OR {ends2} IS NULL OR {first2} = -1 THEN true
        WHEN {first1} = -1 THEN false
        WHEN size({ends1}) = 1 AND size({ends2}) = 1 THEN {first2} % {first1} = 0
        WHEN size({ends1}) = 1 THEN forall({ends2}, e -> e % {first1} = 0 OR e = {total2})
        WHEN size({ends2}) = 1
          THEN size(filter({ends1}, e -> e % {first2} = 0 OR e = {total1})) = ceil({total1} / {first2})
        ELSE {total1} = {total2} AND size(array_except({ends2}, {ends1})) = 0
        END"""


def no_split_text(spec1: str, spec2: str) -> Column:
    """:func:`no_split` for columns with textual specifications, either of which may be an explicit list."""
    return F.expr(ends_merge(spec_ends(spec1), spec_ends(spec2)))


def chunk_of(position: Column, spec: int | list[int]) -> Column:
    """Chunk number of a position along one dimension."""
    if isinstance(spec, int):
        return F.lit(0).cast("bigint") if spec == -1 else F.call_function("div", position - F.pmod(position, F.lit(spec)), F.lit(spec)).cast("bigint")
    ends, total = [], 0
    for size in spec[:-1]:
        total += size
        ends.append(total)
    if not ends:
        return F.lit(0).cast("bigint")
    passed = F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= position)
    return F.size(passed).cast("bigint")
