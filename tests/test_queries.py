"""Every registered query against its SQL, on plain and on skewed tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tests.oracle import connect, differences

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["col_id", "z", "brn"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), connect(SF), SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(n for n, sql in SQL.items() if "lineitem" in sql or "events" in sql))
def test_query_on_skewed_tables(spark, small_groups, skewed_dir, name):
    """One order holds a third of the lines and one configuration a third of the events; all of them, and every
    column deeper than 40 levels, take the routes for groups that no single task may hold."""
    assert differences(QUERIES[name](spark, skewed_dir), connect(skewed_dir), SQL[name]) is None
