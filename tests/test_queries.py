"""Every registered query against its DuckDB twin, and queries without one for plausible rows."""

import datetime
import math

import pytest

from loomgraph.plans import standin
from loomgraph.plans.queries import ORACLES, QUERIES

@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in standin.TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return f"{v:.6f}"
    return v.isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    rel = duck.sql(ORACLES[name])
    columns = sorted(rel.columns)
    assert sorted(df.columns) == columns
    want = sorted(tuple(plain(r[rel.columns.index(c)]) for c in columns) for r in rel.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
