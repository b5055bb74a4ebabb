"""Registered queries: contract, SQL cross-check of a sample, and plan shape."""

import pytest

import __spark_entry__ as entry
from crosscheck import compare, duck

SF = "/root/testdata/sf0.01"
SAMPLE = ["category_counts_hourly", "hour_records_clean", "monthly_coverage", "dup_series_pairs", "persistence_24h", "rolling_bias_7d", "inversion_layers_tol0", "experiment_grid", "fires_by_year"]


def test_contract(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 120 and len(o) >= 105
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("key", SAMPLE)
def test_matches_sql(spark, key):
    problem, n = compare(entry.queries()[key](spark, SF), duck(SF), entry.oracle_sql()[key])
    assert problem is None and n > 0


def plan_of(spark, key):
    return entry.queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["forecast_72h", "samples_72h", "candidate_metrics", "window_overlap", "winter_audit", "severe_risk_table"])
def test_no_pair_joins_and_no_python(spark, key):
    plan = plan_of(spark, key)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan


def test_pushdown_and_pruning(spark):
    plan = plan_of(spark, "fires_by_confidence")
    assert "ReadSchema: struct<o_orderpriority:string>" in plan
    assert "IsNotNull(o_orderpriority)" in plan


def test_ridge_evaluation_makes_the_forecasts_once(spark):
    plan = entry.queries()["ridge_evaluation"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "beta" not in plan and "mean_aqi_7d" not in plan
