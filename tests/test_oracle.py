"""Every registered query with SQL gives the rows DuckDB gives."""

from __future__ import annotations

import datetime as dt
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
from conftest import FOLDER

QUERIES, SQL = driver.queries(), driver.oracle_sql()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if isinstance(value, dt.datetime):
        return value.date()
    return value


def test_all_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    found = QUERIES[name](spark, FOLDER)
    expected = duck.sql(SQL[name])
    names = sorted(found.columns)
    assert names == sorted(expected.columns)
    types = dict(zip(expected.columns, map(str, expected.types)))
    assert {c: TYPES[k] for c, k in found.dtypes} == types
    order = [expected.columns.index(c) for c in names]
    ours = Counter(tuple(_plain(row[c]) for c in names) for row in found.collect())
    theirs = Counter(tuple(_plain(row[i]) for i in order) for row in expected.fetchall())
    assert ours == theirs
