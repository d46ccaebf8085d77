"""Segment plans cover every file."""

import duckdb

from sonolake.plans.catalog import ORACLES, QUERIES


def test_every_file_is_planned(spark, sf_dir):
    """The query and its SQL plan every row of orders."""
    con = duckdb.connect()
    con.sql(f"create view orders as select * from '{sf_dir}/orders.parquet'")
    want = con.sql(ORACLES["segment_plan"])
    got = QUERIES["segment_plan"](spark, sf_dir)
    assert got.select("k").distinct().count() == len(con.sql("select distinct o_orderkey from orders").fetchall())
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
