"""User functions on aligned chunks of several variables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gridspark.operators.layout import with_chunks


def _schema(df: DataFrame, dims: Sequence[str], name: str) -> T.StructType:
    return T.StructType([*[df.schema[d] for d in dims], T.StructField(name, T.DoubleType())])


def map_blocks(
    f: Callable[..., np.ndarray],
    cells: DataFrame,
    dims: Sequence[str],
    variables: Sequence[str],
    chunks: Mapping[str, int | list[int]],
    name: str,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """``f(*arrays)`` on the NumPy arrays of one chunk, cells sorted by ``order`` (default: ``dims``).

    Lower-dimensional variables are attached to the cells first (``with_surface``). A chunk is what one call of
    ``f`` needs at once; choose chunks of many columns but bounded size, cutting ``z`` too where ``f`` allows it.
    """
    dims, order = list(dims), list(order or dims)
    prepared = with_chunks(cells.select(*dims, *variables), chunks)

    def run(chunk: pd.DataFrame) -> pd.DataFrame:
        chunk = chunk.sort_values(order, kind="stable")
        return chunk[dims].assign(**{name: f(*[chunk[v].to_numpy() for v in variables])})

    keys = [f"chunk_{d}" for d in chunks]
    return prepared.groupBy(*keys).applyInPandas(run, _schema(prepared, dims, name))


def map_blocks_coords(
    f: Callable[[pd.DataFrame], pd.Series],
    cells: DataFrame,
    dims: Sequence[str],
    variables: Sequence[str],
    chunks: Mapping[str, int | list[int]],
    name: str,
    coords: Sequence[str] = (),
) -> DataFrame:
    """As :func:`map_blocks`, but ``f`` gets a frame indexed by the chunk's positions, with coordinates."""
    dims = list(dims)
    prepared = with_chunks(cells.select(*dims, *variables, *coords), chunks)

    def run(chunk: pd.DataFrame) -> pd.DataFrame:
        framed = chunk.sort_values(dims, kind="stable").set_index(dims)[[*variables, *coords]]
        return f(framed).rename(name).reset_index()[[*dims, name]]

    keys = [f"chunk_{d}" for d in chunks]
    return prepared.groupBy(*keys).applyInPandas(run, _schema(prepared, dims, name))


def map_cells(
    f: Callable[..., np.ndarray], cells: DataFrame, dims: Sequence[str], variables: Sequence[str], name: str
) -> DataFrame:
    """For element-wise ``f``: any batch of cells is a valid block, so nothing is shuffled."""
    dims = list(dims)
    prepared = cells.select(*dims, *variables)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[dims].assign(**{name: f(*[b[v].to_numpy() for v in variables])})

    return prepared.mapInPandas(run, _schema(prepared, dims, name))


def chunk_counts(cells: DataFrame, chunks: Mapping[str, int | list[int]]) -> DataFrame:
    keys = [f"chunk_{d}" for d in chunks]
    return with_chunks(cells, chunks).groupBy(*keys).agg(F.count("*").alias("cells"))


class Array(NamedTuple):
    """A variable with its own dimensions, in the order of the axes that the function sees."""

    table: DataFrame
    dims: Sequence[str]
    variable: str


def map_arrays(
    f: Callable[..., np.ndarray | tuple[np.ndarray, ...]],
    arrays: Sequence[Array],
    chunks: Mapping[str, int | list[int]],
    template: Sequence[tuple[str, str]],
    dims: Sequence[str] | None = None,
    with_coords: bool = False,
    **kwargs: Any,
) -> DataFrame:
    """``f(*arrays, **kwargs)`` on the aligned chunks of variables of different dimensions.

    ``f`` gets one dense array for each variable, with that variable's axes; positions that a variable lacks are NaN (0 for
    whole numbers). The first variable has all dimensions; the others have some of them and are sent once to each chunk they
    belong to, not to each cell. ``template`` names and types the results, one array each, and ``dims`` are their axes (those
    of the first variable unless given); a function that reduces leaves some out, and the chunks must not cut those.
    ``with_coords`` adds ``coords``, the positions along each axis. Results are given at the positions of the first variable.
    """
    first = arrays[0]
    every, out_dims = list(first.dims), list(dims if dims is not None else first.dims)
    if cut := [d for d, spec in chunks.items() if d not in out_dims and spec != -1]:
        raise ValueError(f"chunks cut {cut}, which the result does not have")
    keys = [f"chunk_{d}" for d in chunks]
    held = [with_chunks(a.table.select(*a.dims, a.variable), {d: s for d, s in chunks.items() if d in a.dims}) for a in arrays]
    whole = held[0].select(*keys).distinct()
    for i, a in enumerate(arrays[1:], 1):
        missing = [f"chunk_{d}" for d in chunks if d not in a.dims]
        if missing:
            shared = [k for k in keys if k not in missing]
            if not shared:
                raise ValueError(f"{a.variable} shares no chunked dimension: pass it as a keyword argument")
            held[i] = held[i].join(whole, shared)
    rows = [
        df.select(
            *keys,
            F.lit(i).alias("_a"),
            *[(F.col(d) if d in a.dims else F.lit(None).cast(first.table.schema[d].dataType)).alias(f"_d_{d}") for d in every],
            *[(F.col(b.variable) if i == j else F.lit(None).cast(b.table.schema[b.variable].dataType)).alias(f"_v{j}") for j, b in enumerate(arrays)],
        )
        for i, (a, df) in enumerate(zip(arrays, held))
    ]
    schema = T.StructType([*[first.table.schema[d] for d in out_dims], *T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in template)).fields])
    axes = [list(a.dims) for a in arrays]

    def run(chunk: pa.Table) -> pa.Table:
        own = [chunk.filter(pa.compute.equal(chunk["_a"], i)) for i in range(len(axes))]
        at = {d: [t[f"_d_{d}"].to_numpy() for t, ax in zip(own, axes) if d in ax] for d in every}
        labels = {d: np.unique(np.concatenate(found)) for d, found in at.items()}
        index = [tuple(np.searchsorted(labels[d], t[f"_d_{d}"].to_numpy()) for d in ax) for t, ax in zip(own, axes)]
        dense = []
        for j, (t, ax) in enumerate(zip(own, axes)):
            values = t[f"_v{j}"].to_numpy()
            empty = np.nan if values.dtype.kind == "f" else np.zeros(1, dtype=values.dtype)[0]
            array = np.full([len(labels[d]) for d in ax], empty, dtype=values.dtype)
            array[index[j]] = values
            dense.append(array)
        extra = {"coords": {d: labels[d] for d in every}} if with_coords else {}
        results = f(*dense, **kwargs, **extra)
        results = results if isinstance(results, tuple) else (results,)
        shape = tuple(len(labels[d]) for d in out_dims)
        if len(results) != len(template) or any(np.shape(r) != shape for r in results):
            raise ValueError(f"expected {len(template)} arrays of shape {shape}, got {[np.shape(r) for r in results]}")
        given = np.zeros(shape, dtype=bool)
        given[tuple(index[0][every.index(d)] for d in out_dims)] = True
        where = np.nonzero(given)
        columns = [pa.array(labels[d][w]) for d, w in zip(out_dims, where)] + [pa.array(np.asarray(r)[where]) for r in results]
        return pa.table(dict(zip(schema.names, columns))).cast(to_arrow_schema(schema))

    return reduce(DataFrame.union, rows).groupBy(*keys).applyInArrow(run, schema)
