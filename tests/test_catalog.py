"""Every reconciliation query against its SQL in another engine."""

import glob
import os

import duckdb
import pytest

from congruity.plans.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if v is None or v != v:
        return "null"
    return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, db, name):
    mine = QUERIES[name](spark, DATA)
    cursor = db.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(mine.columns) == sorted(names)
    got = sorted(tuple(plain(r[c]) for c in sorted(names)) for r in mine.collect())
    want = sorted(tuple(plain(x) for _, x in sorted(zip(names, r, strict=True))) for r in cursor.fetchall())
    assert got == want


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["filter_range"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThan(o_totalprice" in plan
    assert "o_orderpriority" not in plan
