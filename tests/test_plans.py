"""Plan-shape checks: the properties the scale design relies on."""

import re

import pytest

from tillcast.plans.registry import load_all

from conftest import SF_SMALL

SKIP_EXEC = {"model_gbt_scores", "model_rf_scores", "model_importance",
             "model_ensemble_forecast", "forecast_14_days", "orders_csv_roundtrip", "feature_table_roundtrip"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_table_grid_is_never_shuffled(spark):
    df = load_all()["feature_table"].build(spark, SF_SMALL)
    plan = plan_of(df)
    above_grid = plan[:plan.index("Generate")]
    # only broadcasts above the grid expansion, no exchange of the grid itself
    assert not re.search(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition)",
                         above_grid), above_grid
    # two Window operators (item partition; item partition ordered by date)
    assert above_grid.count("Window [") == 2
    # the daily grain is partitioned by item once, explicitly
    assert "REPARTITION_BY_NUM" in plan


def test_lineitem_scan_is_pruned_and_filtered(spark):
    df = load_all()["daily_sales"].build(spark, SF_SMALL)
    df._jdf.queryExecution().executedPlan()          # planned
    text = df._jdf.queryExecution().toString()
    scan = [ln for ln in text.split("\n") if "FileScan parquet" in ln and "l_shipdate" in ln][0]
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in scan
    read_cols = re.search(r"FileScan parquet \[([^\]]*)\]", scan).group(1).split(",")
    assert len(read_cols) == 5                         # 5 of 11 lineitem columns


@pytest.mark.parametrize("name", sorted(n for n in load_all() if n not in SKIP_EXEC))
def test_no_cartesian_or_python(spark, name):
    plan = plan_of(load_all()[name].build(spark, SF_SMALL))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
                "ArrowEvalPython", "PythonUDF"):
        assert bad not in plan, f"{name}: {bad}"
