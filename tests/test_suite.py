import pytest
from compare import duck, same_rows

import __spark_entry__ as entry_module
from sparrel import run_plan
from sparrel.plans.algebra import Query
from sparrel.plans.suite import SUITE

FOLDER = "/root/testdata/sf0.01"
OWN = [n for n in entry_module.oracle_sql() if n[0] in "qbx"]


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", OWN)
def test_against_sql(spark, con, name):
    same_rows(entry_module.queries()[name](spark, FOLDER), con, entry_module.oracle_sql()[name])


@pytest.mark.parametrize("name", SUITE)
def test_json_round_trip(name):
    query = SUITE[name][0]
    assert Query.from_json(query.to_json()) == query


def test_joins_are_not_cartesian(spark):
    for name in ("b02", "b04", "b08", "b09", "b10"):
        plan = run_plan(spark, SUITE[name][0], FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan, name


def test_filters_and_columns_reach_the_scan(spark):
    plan = run_plan(spark, SUITE["q08"][0], FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(p_size,25)" in plan and "ReadSchema: struct<p_name:string,p_size:int>" in plan


def test_entry(spark):
    assert entry_module.entry(spark).count() == 352
