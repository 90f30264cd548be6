"""Every query with SQL gives the same rows in Spark and DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from orefield.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
WITHOUT_SQL = {"atomic_spans"}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in WITHOUT_SQL:
        assert got[1]
        return
    rel = con.sql(SQL[name])
    assert got == rows(list(rel.columns), rel.fetchall())


def test_all_queries_have_sql():
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL
