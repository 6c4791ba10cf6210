"""Registered queries against the DuckDB oracle on the smallest test data."""

import datetime as dt
import math

import duckdb
import pytest

import __spark_entry__ as se
from conftest import SF_CHECK, SF_SMALL

from flockwatch.plans import registry

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents", "benchmark", "embeddings"]
FAST = sorted(se.oracle_sql())


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return repr(v)


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    df = se.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(se.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _canon(df.columns, rows) == _canon(dcols, res.fetchall())


# Adapter A3 has a single basket in the smallest data, so its target queries are tested on larger data too.
@pytest.mark.parametrize("name", ["containment_search", "baskets_meeting_target", "basket_set_algebra", "target_coverage",
                                  "target_vs_sets", "headerless_nested_read", "nested_file_listing", "catalog_file_schemas"])
def test_query_with_rows_on_larger_data(spark, name):
    larger = duckdb.connect()
    for t in TABLES:
        larger.execute(f"create view {t} as select * from read_parquet('{SF_CHECK}/{t}.parquet')")
    df = se.queries()[name](spark, SF_CHECK)
    res = larger.execute(se.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    rows = [tuple(r) for r in df.collect()]
    assert rows and _canon(df.columns, rows) == _canon(dcols, res.fetchall())


def test_every_query_has_a_callable_and_oracles_are_registered():
    qs, sql = se.queries(), se.oracle_sql()
    assert set(sql) <= set(qs)
    assert "outlier_groups" in sql


def test_entry_smoke(spark):
    df = se.entry(spark)
    assert df.columns == ["trade_date", "fund", "side", "n_accts", "total", "mean", "std_dev", "z"]
    assert df.count() == 8


BANNED = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
          "PythonUDF")
MINING = {"recurring_sets", "recurring_set_trades", "recurring_set_summary", "sets_union_export",
          "mined_trade_analysis_firm", "mined_participation_runs"}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - MINING))
def test_plans_have_no_cross_products_or_python(spark, name):
    df = se.queries()[name](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [b for b in BANNED if b in plan], plan
