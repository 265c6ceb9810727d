"""Every registered query of the outcome operators against its SQL in DuckDB, on the smallest driver tables."""

from __future__ import annotations

import duckdb
import pytest

from leadweave.plans.catalog import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(frame):
    cols = sorted(frame.columns)
    for c in cols:
        if "datetime" in str(frame[c].dtype):
            frame[c] = frame[c].astype("datetime64[us]")
    return cols, sorted(map(tuple, frame[cols].astype(str).to_numpy().tolist()))


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.sql(ORACLE[name]).df())


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["filter_range"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
