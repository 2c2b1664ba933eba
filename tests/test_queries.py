"""Every query with SQL against DuckDB, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest
from conftest import SMALL

import __spark_entry__ as entry
from folioframe.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v if isinstance(v, (int, bool, type(None))) else str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, tables, name):
    found = entry.queries()[name](spark, SMALL)
    wanted = tables.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    got = rows(found.columns, [tuple(r) for r in found.collect()])
    assert got == rows(wanted.columns, wanted.fetchall())
    assert got


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLES) <= set(QUERIES)
