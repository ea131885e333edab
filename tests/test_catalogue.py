"""Every catalogued query with SQL gives the same rows in DuckDB."""

import math

import duckdb
import pytest

from cloudframe.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = ("embeddings", "events", "lineitem")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, duck, name):
    frame = catalogue.queries()[name](spark, DATA)
    found = duck.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(frame.columns)
    assert rows(frame.columns, frame.collect()) == rows(columns, found.fetchall())


def test_queries_without_sql_give_rows(spark):
    for name in sorted(catalogue.queries().keys() - catalogue.oracle_sql().keys()):
        found = catalogue.queries()[name](spark, DATA)
        assert found.columns and found.collect(), name
