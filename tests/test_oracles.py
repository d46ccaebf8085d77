"""Every query with an oracle gives DuckDB's rows."""

import math

import duckdb
import pytest

from sonolake.plans.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    v = float(v)
    return None if math.isnan(v) else round(v, 6) + 0.0


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in ORACLES:
        assert df.columns
        return
    oracle = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(oracle.columns)
    at = [oracle.columns.index(c) for c in df.columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in oracle.fetchall()), key=repr)
    assert sorted((tuple(plain(v) for v in r) for r in rows), key=repr) == want
