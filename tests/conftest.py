from __future__ import annotations

import duckdb
import pytest

from gridspark.operators import ranks
from gridspark.session import local_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=2, memory="4g")
    yield session
    session.stop()


@pytest.fixture
def small_groups(monkeypatch):
    """Segments of 8 levels, so that small columns have many of them."""
    monkeypatch.setattr(ranks, "SEGMENT", 8)
    return 8


@pytest.fixture(scope="session")
def skewed_dir(tmp_path_factory):
    """The smallest tables with a third of the lines in one order, many of them exact copies, and a third of the
    events in one configuration."""
    out = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    for name in "region nation customer supplier part orders".split():
        con.execute(f"COPY (SELECT * FROM '{SF}/{name}.parquet') TO '{out}/{name}.parquet' (FORMAT parquet)")
    con.execute(
        f"""COPY (SELECT * EXCLUDE (l_orderkey, i), CASE WHEN i % 3 = 0 THEN 7 ELSE l_orderkey END AS l_orderkey
                  FROM (SELECT row_number() OVER () AS i, * FROM (SELECT * FROM '{SF}/lineitem.parquet' LIMIT 900) l) a
                  UNION ALL BY NAME
                  SELECT * EXCLUDE (l_orderkey, r), 7 AS l_orderkey
                  FROM (SELECT * FROM '{SF}/lineitem.parquet' LIMIT 1) b, (SELECT range AS r FROM range(200)) c)
             TO '{out}/lineitem.parquet' (FORMAT parquet)"""
    )
    con.execute(
        f"""COPY (SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN 8 ELSE user_id END AS user_id,
                  CASE WHEN event_id % 3 = 0 THEN 'click' ELSE event_type END AS event_type, value, props
                  FROM '{SF}/events.parquet') TO '{out}/events.parquet' (FORMAT parquet)"""
    )
    return str(out)
