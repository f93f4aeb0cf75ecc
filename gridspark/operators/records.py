"""Nested records, missing attributes, wildcard comparison and overlays of configuration tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.session import materialize


def flatten_record(df: DataFrame, separator: str = "_") -> DataFrame:
    """Nested fields as top-level columns named by their path; numbers stay, everything else becomes a string."""

    def walk(schema: T.StructType, path: tuple[str, ...]) -> list[Column]:
        out = []
        for field in schema.fields:
            here = (*path, field.name)
            if isinstance(field.dataType, T.StructType):
                out += walk(field.dataType, here)
                continue
            c = F.col(".".join(f"`{p}`" for p in here))
            if not isinstance(field.dataType, T.NumericType):
                c = F.initcap(c.cast("string")) if isinstance(field.dataType, T.BooleanType) else c.cast("string")
            out.append(c.alias(separator.join(here)))
        return out

    return df.select(*walk(df.schema, ()))


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _depth(kind: T.DataType) -> int | None:
    """Levels of named fields of a type; None if the rows decide."""
    if isinstance(kind, T.StructType):
        below = [_depth(f.dataType) for f in kind.fields]
    elif isinstance(kind, T.MapType):
        below = [_depth(kind.valueType)]
    else:
        return None if isinstance(kind, T.VariantType) else 0
    return None if None in below else 1 + max(below, default=0)


def record_leaves(df: DataFrame, keys: Sequence[str], record: str, separator: str = "_") -> DataFrame:
    """Leaves of nested records whose shape may differ from row to row: ``keys``, ``path`` and ``value`` (a variant).

    ``record`` is a struct, a map or a variant, nested to any depth. Names are joined into paths; lists and plain values
    are leaves, records without fields and missing records have none. Every round opens the records of one level, whose
    rows are all of that level's fields, so a round is a narrow projection. A type tells how many rounds there are; for
    variants the records that are left are written down until none is.
    """
    kind = df.schema[record].dataType
    depth = _depth(kind)
    value = F.col(record) if isinstance(kind, T.VariantType) else F.to_variant_object(record)
    level = df.where(F.col(record).isNotNull()).select(*keys, F.lit("").alias("path"), value.alias("value"))
    leaves: list[DataFrame] = []
    while depth is None or depth > 0:
        records = level.where(_is_object(F.col("value")))
        opened = records.withColumnsRenamed({"path": "_path", "value": "_record"})
        fields = opened.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_record").outer()))
        path = F.when(F.col("_path") == "", F.col("key")).otherwise(F.concat("_path", F.lit(separator), "key"))
        level = fields.select(*keys, path.alias("path"), "value")
        if depth is None:
            level = materialize(level, "records")
        leaves.append(level.where(~_is_object(F.col("value"))))
        if depth is not None:
            depth -= 1
        elif level.where(_is_object(F.col("value"))).isEmpty():
            break
    return reduce(DataFrame.union, leaves) if leaves else level.where(F.lit(False))


def _is_list(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))


def flat_items(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Items of lists nested to any depth, which may differ from item to item: ``keys``, ``place`` and ``item`` (a variant).

    ``value`` is a variant or an array. What is no list is its only item, null (not missing) included; empty lists have
    none. ``place`` lists the positions that lead to the item, so items sort by it as a reader meets them. Every round
    opens the lists of one level; what is left is written down until no list is.
    """
    kind = df.schema[value].dataType
    given = F.col(value) if isinstance(kind, T.VariantType) else F.to_variant_object(value) if isinstance(kind, T.ArrayType) else F.col(value).cast("variant")
    level = df.where(F.col(value).isNotNull()).select(*keys, F.array().cast("array<int>").alias("place"), given.alias("item"))
    level = materialize(level, "lists")
    items = [level.where(~_is_list(F.col("item")))]
    while not level.where(_is_list(F.col("item"))).isEmpty():
        lists = level.where(_is_list(F.col("item"))).withColumnRenamed("item", "_list")
        opened = lists.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_list").outer()))
        place = F.concat("place", F.array(F.col("pos").cast("int")))
        level = materialize(opened.select(*keys, place.alias("place"), F.col("value").alias("item")), "lists")
        items.append(level.where(~_is_list(F.col("item"))))
    return reduce(DataFrame.union, items)


def leaf_text(value: Column) -> Column:
    """A leaf as text: lists as JSON, strings as they are, nulls as null."""
    return F.when(F.is_variant_null(value), F.lit(None)).otherwise(F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value)))


def fill_from_record(df: DataFrame, record: Mapping[str, Any]) -> DataFrame:
    """Null attributes taken from one record; attributes that ``df`` lacks are added."""
    filled = {
        name: F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value)
        for name, value in record.items()
    }
    return df.withColumns(filled)


def fill_from_table(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Null attributes taken from the row of ``other`` with the same key; absent columns are added."""
    given = [c for c in other.columns if c not in keys]
    renamed = other.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in given])
    joined = df.join(renamed, list(keys), "left")
    own = [
        F.coalesce(F.col(c), F.col(f"_o_{c}")).alias(c) if c in given else F.col(c)
        for c in df.columns
        if c not in keys
    ]
    return joined.select(*keys, *own, *[F.col(f"_o_{c}").alias(c) for c in given if c not in df.columns])


def has_attributes(want: Mapping[str, Column], have: Mapping[str, Column]) -> Column:
    """Every attribute that ``want`` sets is equal in ``have``."""
    tests = [w.isNull() | F.coalesce(w == have[n], F.lit(False)) if n in have else w.isNull() for n, w in want.items()]
    return reduce(Column.__and__, tests, F.lit(True))


def equals_not_none(a: Mapping[str, Column], b: Mapping[str, Column]) -> Column:
    """Attributes set on both sides are all equal."""
    tests = [F.coalesce(a[n] == b[n], F.lit(True)) for n in a if n in b]
    return reduce(Column.__and__, tests, F.lit(True))


def _ancestors(path: Column) -> Column:
    """Proper prefixes of a dotted path."""
    parts = F.split(path, "\\.")
    lengths = F.sequence(F.lit(1), F.size(parts))
    prefixes = F.transform(lengths, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    return F.slice(prefixes, F.lit(1), F.size(parts) - 1)


def overlay(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Deep merge of configurations stored as leaves ``(key, path, value)``; updates win.

    An updated leaf replaces a base leaf of the same path, a base subtree below it, and a base leaf above it.
    Prefix tests are equi-joins on exploded ancestors.
    """
    named = updates.select(key, "path").distinct()
    above = updates.select(key, F.explode(_ancestors(F.col("path"))).alias("path")).distinct()
    replaced = named.unionByName(above).distinct()
    under = base.select(key, "path", F.explode(_ancestors(F.col("path"))).alias("_above"))
    covered = under.join(named.withColumnRenamed("path", "_above"), [key, "_above"], "left_semi")
    gone = replaced.unionByName(covered.select(key, "path"))
    return base.join(gone, [key, "path"], "left_anti").unionByName(updates.select(*base.columns))
