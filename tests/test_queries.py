"""Every registered query of the merge engine against DuckDB on the same tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tributary.plans import catalogue

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_same_rows(spark, db, name):
    df = catalogue.QUERIES[name](spark, SF)
    want = db.sql(catalogue.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted(repr(tuple(map(plain, r))) for r in df.select(*columns).collect())
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
