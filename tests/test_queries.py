"""Every registered query against its oracle in DuckDB."""

import glob
import os

import duckdb
import pytest

from veinstone.plans.catalogue import QUERIES, oracles, queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for p in glob.glob(SMALL + "/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, oracle, name):
    df = queries()[name](spark, SMALL)
    want = oracle.sql(oracles()[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    got = sorted(repr([plain(r[c]) for c in order]) for r in df.collect())
    assert got == sorted(repr([plain(r[want.columns.index(c)]) for c in order]) for r in want.fetchall())
