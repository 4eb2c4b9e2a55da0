"""Every named query against its SQL in DuckDB, over the smallest tables."""

import os

import duckdb
import pytest

from arbora.plans.catalog_queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _norm(x):
    if isinstance(x, float):
        return f"{x:.6g}"
    if isinstance(x, bool) or x is None:
        return str(x)
    return str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(_norm(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name not in ORACLES:
        return
    res = duck.execute(ORACLES[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    want = [tuple(_norm(r[cols.index(c)]) for c in sorted(cols)) for r in res.fetchall()]
    assert sorted(got) == sorted(want)
