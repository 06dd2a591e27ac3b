"""Every registered query against its SQL twin, and the plans they run."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry_points
from sessionlens.plans import oracles
from sessionlens.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
ORACLES = oracles.build()
ROWS_ONLY = {
    "dq_live_scorecard",
    "isolation_forest_score",
    "autoencoder_errors",
}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_entry_points_hold_the_catalog():
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(ORACLES) <= set(entry_points.oracle_sql())


def test_every_query_has_a_twin_unless_approximate():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - ROWS_ONLY))
def test_query_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(ROWS_ONLY - {"autoencoder_errors"}))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


PYTHON = {
    "isolation_forest_score",
    "isolation_forest_checks",
    "autoencoder_errors",
    "autoencoder_checks",
}
DRAINED = {n for n in QUERIES if n.startswith(("stream_", "sink_", "src_"))}


def plan_of(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - PYTHON - DRAINED))
def test_plan_stays_on_the_jvm_without_cross_joins(spark, name):
    plan = plan_of(spark, name)
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "InPandas", "EvalPython"):
        assert operator not in plan
