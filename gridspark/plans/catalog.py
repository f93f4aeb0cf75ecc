"""Catalogue of stored dataset versions and requests against it.

A version row has ``name``, the attributes ``format``, ``dim_order``, ``coords`` and one ``chunk_<dim>`` column per
dimension: a number (``-1`` unsplit), the text form of an explicit list (``10,20,30``) or null for no preference. Many
requests are answered in one job: versions and requests are first reduced to their distinct attribute combinations, which
meet in an equi-join on the attributes that a request sets; chunks are tested on the pairs that it gives.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions import chunks as ch
from gridspark.operators.layout import rechunk, same_chunks
from gridspark.operators.records import fill_from_record
from gridspark.operators.structure import drop_coords, transpose
from gridspark.session import scratch_path

ATTRIBUTES = ("format", "dim_order", "coords")
ANY = "*"  # key of an unset attribute

# How a request attribute r accepts a version attribute v.
SAME_OR_UNSET = "same or either unset"
SAME_IF_SET = "same where the request sets it"
MERGEABLE = "chunks can be merged without a split"


def _key(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(ANY))


def _chunk_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("chunk_")]


def _version_tokens(attr: str) -> Column:
    """What a version answers to in one attribute: its value (or that it has none), and requests that leave it open."""
    return F.array(F.coalesce(F.concat(F.lit("="), F.col(attr).cast("string")), F.lit("unset")), F.lit("open"))


def _request_tokens(attr: str, rule: str) -> Column:
    """What a request asks for in one attribute; with either side unset a version without a value will do too."""
    value = F.concat(F.lit("="), F.col(attr).cast("string"))
    asked = F.array(value, F.lit("unset")) if rule == SAME_OR_UNSET else F.array(value)
    return F.when(F.col(attr).isNull(), F.array(F.lit("open"))).otherwise(asked)


def _ends(column: str) -> Column:
    return F.expr(ch.spec_ends(f"nullif({column}, '{ANY}')"))


def match_versions(
    versions: DataFrame, requests: DataFrame, rules: Mapping[str, str], ignore_chunks_unless: str | None = None
) -> DataFrame:
    """Matching pairs of distinct combinations.

    Rows: the request combination as keys ``r_<attr>``, the version's as ``v_<attr>``, the number of versions that
    have it and the one with the least name (``first``: name and attributes). With ``ignore_chunks_unless`` chunk columns
    only count for that format. A pair meets under exactly one token per attribute, so the join gives each pair once and
    no pair that the attributes rule out.
    """
    attrs = list(rules)
    plain, chunks = [a for a in attrs if not a.startswith("chunk_")], [a for a in attrs if a.startswith("chunk_")]

    def version_key(a: str) -> Column:
        if ignore_chunks_unless and a in chunks:
            counts = F.coalesce(F.col("format") == ignore_chunks_unless, F.lit(False))
            return F.when(counts, _key(F.col(a))).otherwise(F.lit(ANY))
        return _key(F.col(a))

    sigs = versions.groupBy(*[version_key(a).alias(f"v_{a}") for a in attrs], *[F.col(a).alias(f"t_{a}") for a in plain]).agg(
        F.count("*").alias("versions"), F.min(F.struct("name", *attrs)).alias("first")
    )
    wanted = requests.select(*attrs).distinct().select(*[_key(F.col(a)).alias(f"r_{a}") for a in attrs], *[F.col(a).alias(f"t_{a}") for a in plain])
    sides = []
    for side, tokens in (
        (sigs, {a: _version_tokens(f"t_{a}") for a in plain}),
        (wanted, {a: _request_tokens(f"t_{a}", rules[a]) for a in plain}),
    ):
        for a, token in tokens.items():
            side = side.withColumn(f"t_{a}", F.explode(token))
        sides.append(side)
    pairs = sides[0].join(sides[1], [f"t_{a}" for a in plain])
    for c in chunks:
        v, r = F.col(f"v_{c}"), F.col(f"r_{c}")
        if rules[c] == MERGEABLE:
            pairs = pairs.withColumn("_v", _ends(f"v_{c}")).withColumn("_r", _ends(f"r_{c}"))
            fits = (v == ANY) | F.expr(ch.ends_merge("_v", "_r"))
        else:
            fits = (r == ANY) | (v == r) | ((v == ANY) & F.lit(rules[c] == SAME_OR_UNSET))
        pairs = pairs.filter(fits)
    return pairs.select(*[f"r_{a}" for a in attrs], *[f"v_{a}" for a in attrs], "versions", "first")


def per_request(requests: DataFrame, answers: DataFrame, attrs: Sequence[str], how: str = "left") -> DataFrame:
    """Bring the answers of request combinations (``r_<attr>`` keys) back to the requests."""
    keyed = requests.withColumns({f"r_{a}": _key(F.col(a)) for a in attrs})
    keys = [f"r_{a}" for a in attrs]
    return keyed.join(answers, keys, how).drop(*keys)


def order_rules(df: DataFrame) -> dict[str, str]:
    """Rules of the version order: attributes equal or unset, chunks of chunked versions mergeable."""
    return {**{a: SAME_OR_UNSET for a in ATTRIBUTES}, **{c: MERGEABLE for c in _chunk_columns(df)}}


def count_matches(
    versions: DataFrame, requests: DataFrame, rules: Mapping[str, str], ignore_chunks_unless: str | None = None
) -> DataFrame:
    """Requests with the number of versions they accept and the least name among them."""
    pairs = match_versions(versions, requests, rules, ignore_chunks_unless)
    answers = pairs.groupBy(*[f"r_{a}" for a in rules]).agg(
        F.sum("versions").cast("bigint").alias("matches"), F.min("first.name").alias("first_name")
    )
    out = per_request(requests, answers, list(rules))
    return out.withColumn("matches", F.coalesce("matches", F.lit(0).cast("bigint")))


def versions_below(versions: DataFrame, requests: DataFrame) -> DataFrame:
    """How many stored versions the request can be built from without loss (``version <= request``)."""
    return count_matches(versions, requests, order_rules(versions), "zarr")


def has_version(versions: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests for which a version with the same set attributes and the same requested chunks exists."""
    rules = {a: SAME_IF_SET for a in (*ATTRIBUTES, *_chunk_columns(versions))}
    pairs = match_versions(versions, requests, rules)
    answers = pairs.select(*[f"r_{a}" for a in rules]).distinct()
    return per_request(requests, answers, list(rules), "left_semi")


def resolve_versions(versions: DataFrame, requests: DataFrame, source: Mapping[str, Any]) -> DataFrame:
    """The stored version closest to each request, or the source.

    Of the versions below a request the maximal ones are kept: a chunked version is dropped if a coarser chunking
    that it can be merged into is available too. Among several maxima the least name wins. The answer is the request
    with unset attributes taken from the chosen version.
    """
    versions = fill_from_record(versions, {a: source[a] for a in ATTRIBUTES})
    chunks = _chunk_columns(versions)
    rules = order_rules(versions)
    pairs = match_versions(versions, requests, rules, "zarr")
    request_keys = [f"r_{a}" for a in rules]
    if chunks:
        # a candidate is beaten by one of the same request and attributes with other chunks that its own merge into
        own = pairs.filter(F.col("v_format") == "zarr").select(
            *[F.col(k).alias(f"o_{k}") for k in (*request_keys, *[f"v_{a}" for a in ATTRIBUTES])],
            *[F.col(f"v_{c}").alias(f"o_v_{c}") for c in chunks],
            *[_ends(f"v_{c}").alias(f"o_e_{c}") for c in chunks],
        )
        ended = pairs.withColumns({f"e_{c}": _ends(f"v_{c}") for c in chunks})
        same = [F.col(k) == F.col(f"o_{k}") for k in (*request_keys, *[f"v_{a}" for a in ATTRIBUTES])]
        merges = [(F.col(f"v_{c}") == F.col(f"o_v_{c}")) | ((F.col(f"o_v_{c}") != ANY) & F.expr(ch.ends_merge(f"e_{c}", f"o_e_{c}"))) for c in chunks]
        differs = reduce(Column.__or__, [F.col(f"v_{c}") != F.col(f"o_v_{c}") for c in chunks])
        beaten = reduce(Column.__and__, [*same, *merges, differs])
        pairs = ended.join(own, beaten, "left_anti").drop(*[f"e_{c}" for c in chunks])
    best = pairs.groupBy(*request_keys).agg(F.min("first").alias("_best"))
    chosen = per_request(requests, best, list(rules))
    keep = [c for c in requests.columns if c not in rules]
    filled = [
        F.coalesce(
            F.col(a), F.when(F.col("_best").isNotNull(), F.col(f"_best.{a}")).otherwise(F.lit(source.get(a)))
        ).alias(a)
        for a in rules
    ]
    return chosen.select(*keep, F.coalesce("_best.name", F.lit("source")).alias("name"), *filled)


def incomplete_versions(versions: DataFrame, required: Sequence[str]) -> DataFrame:
    """Versions that cannot serve as a source: an attribute or a chunk size is unset."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    return versions.withColumn("missing", F.array_join(missing, ",")).filter("missing != ''")


def list_versions(frames: Sequence[DataFrame], source: Mapping[str, Any], tag: str = "0") -> DataFrame:
    """All catalogue rows; entries written before an attribute existed take it from the source version."""
    merged = frames[0]
    for f in frames[1:]:
        merged = merged.unionByName(f, allowMissingColumns=True)
    return fill_from_record(merged, {**source, "tag": tag})


# ---------------------------------------------------------------- one dataset and its stored versions


@dataclass(frozen=True)
class Version:
    """Properties of one version; None leaves a property open."""

    format: str | None = None
    dim_order: str | None = None
    chunks: Mapping[str, int | list[int] | str | None] = field(default_factory=dict)
    name: str = ""
    coords: bool | None = None


def impose(
    cells: DataFrame,
    version: Version,
    coords: Sequence[str] = (),
    current: Mapping | None = None,
) -> DataFrame:
    """Bring a cell table into the form of a version: dimension order, chunks, coordinates.

    The rows of a chunk are placed together first and then sorted inside their partition in dimension order. Cells whose
    ``current`` chunks are the wanted ones stay where they are, with their chunk columns.
    """
    chunks = {d: s for d, s in version.chunks.items() if s is not None and s != "auto"}
    if version.coords is False:
        cells = drop_coords(cells, coords)
    dims = list(version.dim_order) if version.dim_order is not None else []
    same = current is not None and all(same_chunks(s, current.get(d, -1)) for d, s in chunks.items())
    if current is not None and same:
        return cells if not dims else cells.select(*dims, *[c for c in cells.columns if c not in dims])
    if chunks:
        cells = rechunk(cells, chunks)
        if dims:
            rest = [c for c in cells.columns if c not in dims]
            cells = cells.select(*dims, *rest).sortWithinPartitions(*[f"chunk_{d}" for d in chunks], *dims)
    elif dims:
        cells = transpose(cells, dims)
    return cells


class FieldStore:
    """A dataset with a source and versions stored as Parquet under ``path``."""

    def __init__(
        self,
        spark: SparkSession,
        name: str,
        source: Callable[[Version], DataFrame],
        source_version: Version,
        path: str | None = None,
        coords: Sequence[str] = (),
    ) -> None:
        unset = [k for k, v in asdict(source_version).items() if v is None]
        if unset:
            raise ValueError(f"source version leaves attributes open: {unset}")
        missing = [d for d in source_version.dim_order if source_version.chunks.get(d) is None]
        if missing:
            raise ValueError(f"source version lacks chunks of: {missing}")
        self.spark, self.name, self.source, self.coords = spark, name, source, tuple(coords)
        self.source_version = source_version
        self.dims = list(source_version.dim_order)
        self.path = path or scratch_path(spark, f"store-{name}")

    def _row(self, v: Version) -> dict[str, Any]:
        chunk = {f"chunk_{d}": self._text(v.chunks.get(d)) for d in self.dims}
        return {"format": v.format, "dim_order": v.dim_order, "coords": v.coords, **chunk}

    @staticmethod
    def _text(spec: Any) -> str | None:
        if isinstance(spec, (list, tuple)):
            return ",".join(str(n) for n in spec) if len(spec) > 1 else "-1"
        return None if spec is None or spec == "auto" else str(spec)

    @staticmethod
    def _spec(text: str) -> int | list[int]:
        return [int(n) for n in text.split(",")] if "," in text else int(text)

    def _schema(self) -> str:
        chunk = ", ".join(f"chunk_{d} string" for d in self.dims)
        return f"name string, format string, dim_order string, coords boolean, {chunk}"

    def _frame(self, v: Version) -> DataFrame:
        row = {"name": v.name, **self._row(v)}
        types = {"coords": "boolean"}
        return self.spark.range(0, 1, 1, 1).select(*[F.lit(x).cast(types.get(k, "string")).alias(k) for k, x in row.items()])

    def _stored(self) -> DataFrame:
        if not self._exists():
            return self._frame(self.source_version).filter(F.lit(False))
        # one row per stored version of this dataset; a single partition spares the shuffles
        return self.spark.read.schema(self._schema()).parquet(f"{self.path}/catalogue").coalesce(1)

    def _exists(self) -> bool:
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/catalogue")
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)

    def list_versions(self) -> DataFrame:
        """Source and stored versions."""
        source = self.source_version
        first = self._frame(Version(source.format, source.dim_order, source.chunks, "source", source.coords))
        return list_versions([first, self._stored()], self._row(source)).coalesce(1)

    def has_version(self, version: Version) -> bool:
        return not has_version(self.list_versions(), self._frame(version).drop("name")).isEmpty()

    def get_version(
        self, version: Version, weak: bool = True, create: bool = True, add: bool = False
    ) -> tuple[DataFrame, Version] | None:
        """Cells of the closest stored version, else made from the source; None if that is not allowed.

        ``weak`` accepts a version whose chunks merge into the requested ones, otherwise the requested attributes
        and chunks must be the same.
        """
        request = self._frame(version).drop("name")
        source_row = self._row(self.source_version)
        stored = self._stored()
        if not weak:
            wanted = {a: v for a, v in self._row(version).items() if v is not None}
            for a, v in wanted.items():
                stored = stored.filter(F.col(a) == v)
        answer = resolve_versions(stored, request, source_row).first()
        chunks = {d: self._spec(answer[f"chunk_{d}"]) for d in self.dims if answer[f"chunk_{d}"] is not None}
        found = Version(answer["format"], answer["dim_order"], chunks, answer["name"], answer["coords"])
        if found.name != "source":
            cells = self.spark.read.parquet(f"{self.path}/{found.name}")
            row = self._stored().filter(F.col("name") == found.name).first()
            have = {d: self._spec(row[f"chunk_{d}"]) for d in self.dims}
            split = {d: s for d, s in chunks.items() if s != -1}
            if all(same_chunks(s, have[d]) for d, s in chunks.items()) and all(f"chunk_{d}" in cells.columns for d in split):
                # chunked alike: no shuffle, and predicates on the chunk columns still prune directories
                return impose(cells, Version(chunks=chunks, dim_order=found.dim_order), current=have), found
            cells = cells.drop(*[c for c in cells.columns if c.startswith("chunk_")])
            return impose(cells, Version(chunks=chunks, dim_order=found.dim_order)), found
        if not create:
            source = self.list_versions().filter("name = 'source'")
            fits = versions_below(source, request) if weak else has_version(source, request).withColumn("matches", F.lit(1))
            if fits.filter("matches > 0").isEmpty():
                return None
        cells = impose(self.source(found), found, self.coords)
        if add:
            self.add_version(found, cells)
        return cells, found

    def add_version(self, version: Version, cells: DataFrame | None = None) -> Version:
        """Store a version unless one with the same properties exists."""
        if self.has_version(version):
            return version
        if version.format == "grib":
            raise NotImplementedError("message files are read only")
        name = version.name if version.name not in ("", "source") else scratch_path(self.spark, "v").rsplit("/", 1)[1]
        if not self.list_versions().filter(F.col("name") == name).isEmpty():
            raise ValueError(f"a version named {name} exists already")
        if cells is None:
            cells, version = self.get_version(version)
        if version.format not in ("zarr", "netcdf"):
            raise ValueError(f"cannot store format {version.format}")
        chunks = {d: version.chunks.get(d) for d in self.dims}
        chunks = {d: -1 if s is None or s == "auto" else s for d, s in chunks.items()}
        new = Version(version.format, version.dim_order, chunks, name, version.coords)
        split = [f"chunk_{d}" for d, s in chunks.items() if s != -1]
        target = f"{self.path}/{name}"
        plain = cells.drop(*[c for c in cells.columns if c.startswith("chunk_")])
        if version.format == "zarr" and split:
            impose(plain, new, self.coords).drop(
                *[f"chunk_{d}" for d, s in chunks.items() if s == -1]
            ).write.partitionBy(*split).parquet(target)
        else:
            impose(plain, Version(dim_order=new.dim_order, coords=new.coords), self.coords).write.parquet(target)
        self._frame(new).write.mode("append").parquet(f"{self.path}/catalogue")
        return new
