"""Forecasts fed back day by day against plain Python."""

import datetime as dt
import statistics

import pytest
from pyspark.sql import functions as F

from tillcast import schemas
from tillcast.plans import recursive as R
from tillcast.sources.fixtures import Calendar

CAL = Calendar("2024-01-01", "2024-01-20", "2024-01-31", "2024-02-01", horizon=5)
WEIGHTS = {"qty_sold_lag1": 0.5, "qty_sold_lag7": -0.2, "rolling_qty_sold_mean": 0.4, "rolling_qty_sold_std": 0.3,
           "rolling_qty_sold_median": 0.1, "promotion": 2.0, "weekDay": -0.1}


@pytest.fixture
def inputs(spark):
    start = dt.datetime(2024, 1, 31, 12)
    lines = [(start - dt.timedelta(days=k), 1, (k * 7) % 5 + 1, 2.0) for k in range(25)]
    lines += [(start - dt.timedelta(days=k), 2, 30 * (k == 2), 3.0) for k in (0, 2, 2, 40)]
    lines += [(start + dt.timedelta(days=1), 1, 99, 2.0)]  # on the forecast's first day: not history
    orders = spark.createDataFrame(lines, schemas.ORDERS)
    items = spark.createDataFrame([(k, "b", "m", 1.0, "x", "y", "z", 5.0) for k in (1, 2, 3)], schemas.ITEMS)
    infos = spark.createDataFrame([(1, 2.0, "2024-02-02,2024-02-04"), (2, 3.0, None)], schemas.INFOS)
    return orders, items, infos


def _history(orders, item):
    last = dt.date(2024, 1, 31)
    units = [0.0] * R.HISTORY
    for r in orders.where(F.col("itemID") == item).collect():
        back = (last - r["time"].date()).days
        if 0 <= back < R.HISTORY:
            units[R.HISTORY - 1 - back] += r["order"]
    return units


def test_linear_recursion_against_python(spark, inputs):
    orders, items, infos = inputs
    got = R.recursive_forecast(R.item_state(orders, items, infos, CAL), R.linear_predictor(WEIGHTS, 0.1), CAL).collect()
    found = {(r["itemID"], r["date"]): r["prediction"] for r in got}
    assert len(got) == len(found) == 3 * CAL.horizon
    for item, promo in ((1, {2, 4}), (2, set()), (3, set())):
        h = _history(orders, item)
        for k in range(CAL.horizon):
            day = dt.date(2024, 2, 1 + k)
            week = h[-7:]
            p = 0.1 + 0.5 * h[-1] - 0.2 * h[-7] + 0.4 * sum(week) / 7 + 0.3 * statistics.stdev(week) + 0.1 * statistics.median(week)
            p += 2.0 * (day.day in promo) - 0.1 * day.isoweekday()
            h.append(max(0.0, p))
            assert abs(found[item, day] - h[-1]) < 1e-9


def test_counted_lines_give_the_same_state(inputs):
    from tillcast.operators.prepare import line_kinds
    orders, items, infos = inputs
    one = R.item_state(orders, items, infos, CAL).select("itemID", "_history").collect()
    assert sorted(one) == sorted(R.item_state(line_kinds(orders), items, infos, CAL).select("itemID", "_history").collect())


def test_trees_learn_a_repeating_series(spark, inputs):
    _, items, infos = inputs
    rows = []
    for item in (1, 2, 3):
        units = [float((d % 7) + item) for d in range(60)]
        for d in range(14, 60):
            week = units[d - 7:d]
            rows.append((units[d], units[d - 1], units[d - 2], units[d - 3], units[d - 7], sum(week) / 7, statistics.stdev(week), statistics.median(week)))
    table = spark.createDataFrame(rows, ["qty_sold", *R.SERIES_FEATURES]).withColumns(
        {c: F.lit(None).cast("double") for c in R.DAY_FEATURES + R.ITEM_FEATURES})
    history = spark.createDataFrame([(k, [float((d % 7) + k) for d in range(60 - R.HISTORY, 60)]) for k in (1, 2, 3)], "itemID long, _history array<double>")
    state = items.join(history, "itemID").withColumn("_promo", F.array().cast("array<date>"))
    trees = R.tree_predictor(table, rounds=8, rate=0.7, depth=4)
    days = R.recursive_forecast(state, lambda df: trees(df).withColumn("prediction", F.rint("prediction")), CAL)
    for r in days.collect():
        assert abs(r["prediction"] - (((60 + (r["date"] - dt.date(2024, 2, 1)).days) % 7) + r["itemID"])) < 0.8


def test_no_orders_and_no_items(spark, inputs):
    orders, items, infos = inputs
    none = R.recursive_forecast(R.item_state(orders.limit(0), items, infos, CAL), R.linear_predictor({"qty_sold_lag1": 1.0}), CAL)
    assert none.agg(F.count("*"), F.sum("prediction")).first()[:] == (15, 0.0)
    assert R.recursive_forecast(R.item_state(orders, items.limit(0), infos, CAL), R.linear_predictor({}), CAL).count() == 0


def test_registered_forecast_grows_all_rounds(spark, monkeypatch):
    from conftest import SF_SMALL
    from tillcast.plans.registry import load_all
    asked = []

    def fit(train, features, label, rounds=R.boosting.ROUNDS, **params):
        asked.append((rounds, params))
        return R.boosting.Boosted(list(features), 1.0, 0.1, [])
    monkeypatch.setattr(R.boosting, "fit", fit)
    load_all()["recursive_tree_forecast"].spark(spark, SF_SMALL)
    assert asked == [(50, {})]
