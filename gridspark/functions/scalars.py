"""Scalar, string, map and array helpers over configuration and result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridspark.functions.ieee import ieee_div


def slurm_seconds(text: Column) -> Column:
    """Seconds of a batch-system duration: ``M``, ``M:S``, ``H:M:S``, ``D-H``, ``D-H:M`` or ``D-H:M:S``."""
    has_days = F.contains(text, F.lit("-"))
    days = F.when(has_days, F.split_part(text, F.lit("-"), F.lit(1)).cast("bigint")).otherwise(F.lit(0))
    clock = F.split(F.when(has_days, F.split_part(text, F.lit("-"), F.lit(2))).otherwise(text), ":")

    def part(i: int) -> Column:
        return F.coalesce(F.get(clock, F.lit(i)).cast("bigint"), F.lit(0))

    with_days = part(0) * 3600 + part(1) * 60 + part(2)
    without_days = (
        F.when(F.size(clock) == 1, part(0) * 60)
        .when(F.size(clock) == 2, part(0) * 60 + part(1))
        .otherwise(with_days)
    )
    return (days * 86400 + F.when(has_days, with_days).otherwise(without_days)).cast("bigint")


def parse_bool(text: Column) -> Column:
    """Case-insensitive ``true`` / ``false``; anything else is an error."""
    low = F.lower(text)
    return (
        F.when(low == "true", F.lit(True))
        .when(low == "false", F.lit(False))
        .when(text.isNull(), F.lit(None).cast("boolean"))
        .otherwise(F.raise_error(F.concat(F.lit("cannot parse to boolean: "), text)).cast("boolean"))
    )


def map_keys(m: Column, renames: Column) -> Column:
    """Rekey map ``m`` through map ``renames``."""
    return F.transform_keys(m, lambda k, _: F.element_at(renames, k))


def map_inverse(m: Column) -> Column:
    """Swap keys and values; of equal values the last entry wins, whatever the session's duplicate policy."""
    entries = F.map_entries(m)
    last = F.filter(
        entries,
        lambda e, i: ~F.exists(
            F.slice(entries, i + F.lit(2), F.size(entries)), lambda later: later["value"] == e["value"]
        ),
    )
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["value"], e["key"])))


def flat_list(c: Column, depth: int) -> Column:
    """Flat array from a value nested ``depth`` arrays deep (0: a scalar becomes a one-element array)."""
    if depth == 0:
        return F.array(c)
    for _ in range(depth - 1):
        c = F.flatten(c)
    return c


def variant_label(name: Column, args: Column, options: Column) -> Column:
    """Label of a parametrised variant: ``name_arg_key=value``."""
    pairs = F.transform(
        F.array_sort(F.map_entries(options)),
        lambda e: F.concat(e["key"], F.lit("="), e["value"]),
    )
    return F.array_join(F.concat(F.array(name), args, pairs), "_")


def repeated_name(n: Column) -> Column:
    return F.concat(F.lit("repeated_"), n.cast("string"))


def dim_list(order: Column) -> Column:
    """Compact dimension order (``"xyz"``) as an array."""
    return F.split(order, "")


def expand_order(order: Column, names: Mapping[str, str]) -> Column:
    """Compact order to verbose dimension names."""
    index = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.transform(dim_list(order), lambda k: F.element_at(index, k))


def compact_order(order: Column, names: Mapping[str, str]) -> Column:
    """Verbose dimension names to the compact order; inverse of :func:`expand_order`."""
    index = F.create_map(*[F.lit(x) for k, v in names.items() for x in (v, k)])
    return F.array_join(F.transform(order, lambda k: F.element_at(index, k)), "")


def dims_to_drop(have: Column, want: Column) -> Column:
    return F.array_except(have, want)


def dims_to_add(have: Column, want: Column) -> Column:
    return F.array_except(want, have)


def all_dims(*orders: Column) -> Column:
    """Dimensions of several arrays in order of first appearance."""
    return F.array_distinct(F.concat(*orders))


def amdahl_speedup(f: Column, c: Column) -> Column:
    """Speedup on ``c`` cores for the serial fraction ``f``."""
    return ieee_div(F.lit(1.0), f + ieee_div(F.lit(1.0) - f, c))


def literal_map(d: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def string_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])
