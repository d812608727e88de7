"""Every catalogue query against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from conftest import SF
from graphloom.plans import catalogue


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(float(r[i])) if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else repr(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_matches_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(catalogue.QUERIES) == set(catalogue.SQL)
