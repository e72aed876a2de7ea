"""Every query with SQL against DuckDB on the smallest tables, plan checks, and identities."""

import math
import os

import __spark_entry__ as entry
import duckdb
import pytest
from haruspex import plans

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(D):
        con.execute(f"create view {f.split('.')[0]} as select * from '{D}/{f}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 8) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_against_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    rows = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if name not in plans.SQL:
        assert rows
        return
    x = duck.execute(plans.SQL[name])
    at = [[c[0] for c in x.description].index(c) for c in cols]
    assert rows == sorted(tuple(norm(y[i]) for i in at) for y in x.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(plans.SQL) - {"src01_run_file_round_trip"}))
def test_no_python_in_plans_with_sql(spark, name):
    plan = plans.QUERIES[name](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "CartesianProduct"))


def test_filters_and_columns_reach_the_scan(spark):
    plan = plans.QUERIES["join05_semi_anti"](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderpriority), EqualTo(o_orderpriority,1-URGENT)" in plan
    plan = plans.QUERIES["agg35_distinct"](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string>" in plan
