"""Compare registered queries with their SQL on the same Parquet files.

``python -m tests.oracle [sf_dir] [query ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        if path.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _cell(v: object) -> object:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    return repr(float(v)) if isinstance(v, (int, float)) else str(v)


def _rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def kind(name: str) -> str:
    """Coarse type, the same word for both engines."""
    low = name.lower()
    for word, kinds in {
        "int": ("bigint", "long"),
        "small": ("int", "integer", "smallint", "tinyint", "short"),
        "double": ("double",),
        "text": ("string", "varchar"),
        "bool": ("boolean",),
    }.items():
        if low in kinds:
            return word
    return low


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if both give the same columns, types and rows."""
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    spark_kinds = {f.name: kind(f.dataType.simpleString()) for f in df.schema.fields}
    duck_kinds = {d[0]: kind(str(d[1])) for d in cur.description}
    if spark_kinds != duck_kinds:
        return f"types {spark_kinds} != {duck_kinds}"
    a, b = _rows(df.columns, got), _rows(names, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, first: {bad[0]}" if bad else None


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from gridspark.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark: SparkSession = local_session("8")
    con = connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in argv[1:] or list(queries):
        start = time.perf_counter()
        try:
            df = queries[name](spark, sf_dir)
            if name in sqls:
                problem = differences(df, con, sqls[name])
            else:
                n = df.count()
                problem = None if n else "no rows"
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += problem is not None
        note = "ok" if problem is None else f"FAIL {problem}"
        print(f"{name:24s} {time.perf_counter() - start:6.2f}s {'' if name in sqls else '(rows only) '}{note}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
