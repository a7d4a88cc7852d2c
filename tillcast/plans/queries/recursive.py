"""Forecasts that feed their own predictions back."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tillcast.plans import features as E1
from tillcast.plans import oracle as O
from tillcast.plans import recursive as R
from tillcast.plans.queries.common import LC, _li
from tillcast.plans.registry import register
from tillcast.schemas import LAGS, ROLLING_DAYS
from tillcast.sources import fixtures as FX

#: A fixed predictor, which SQL can follow day by day.
_WEIGHTS = {"qty_sold_lag1": 0.3, "qty_sold_lag2": -0.1, "qty_sold_lag3": 0.05, "qty_sold_lag7": 0.25, "rolling_qty_sold_mean": 0.3,
            "rolling_qty_sold_std": 0.1, "rolling_qty_sold_median": 0.2, "promotion": 1.5, "weekDay": -0.05, "day": 0.01}
_CONSTANT = 0.2


def _state(spark, sf):
    return R.item_state(_li(spark, sf), FX.items(spark, sf), FX.infos(spark, sf), LC)


def _linear_sql() -> str:
    last = f"list_slice(hist, -{ROLLING_DAYS}, -1)"
    value = {**{f"qty_sold_lag{k}": f"hist[-{k}]" for k in LAGS},
             "rolling_qty_sold_mean": f"list_aggregate({last}, 'avg')", "rolling_qty_sold_std": f"list_aggregate({last}, 'stddev_samp')",
             "rolling_qty_sold_median": f"list_aggregate({last}, 'median')",
             "promotion": "CAST(list_contains(promo, date) AS INT)", "weekDay": "isodow(date)", "day": "day(date)"}
    total = " + ".join([O.dbl(_CONSTANT), *(f"{O.dbl(w)} * {value[f]}" for f, w in _WEIGHTS.items())])
    start = O.d(LC.forecast_start)
    return O.with_(*O.LINEITEM.views(), f"""units AS (
  SELECT itemID, CAST(time AS DATE) AS date, CAST(sum("order") AS DOUBLE) AS units FROM txn
  WHERE CAST(time AS DATE) < {start} GROUP BY 1, 2),
days AS (SELECT CAST(unnest(generate_series({start} - INTERVAL {R.HISTORY} DAY, {start} - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS date),
state AS (
  SELECT i.itemID, list(coalesce(u.units, 0) ORDER BY d.date) AS hist,
         any_value(coalesce(list_transform(string_split(f.promotion, ','), lambda x: CAST(trim(x) AS DATE)), [])) AS promo
  FROM items_v i CROSS JOIN days d LEFT JOIN units u ON u.itemID = i.itemID AND u.date = d.date LEFT JOIN infos_v f ON f.itemID = i.itemID
  GROUP BY i.itemID)""") + f"""SELECT itemID, CAST(date - INTERVAL 1 DAY AS DATE) AS date, hist[-1] AS prediction FROM (
  WITH RECURSIVE f(itemID, date, hist, promo) AS (
    SELECT itemID, {start}, hist, promo FROM state
    UNION ALL
    SELECT itemID, CAST(date + INTERVAL 1 DAY AS DATE), list_append(hist, greatest(0.0, {total})), promo
    FROM f WHERE date < {start} + INTERVAL {LC.horizon} DAY)
  SELECT * FROM f WHERE date > {start})"""


@register("recursive_linear_forecast", _linear_sql(), fuzz=("prediction",), ops=("M11", "W6", "W7", "W8"))
def q_recursive_linear_forecast(spark, sf):
    """Units of every item on each of the 14 forecast days by a fixed linear predictor, whose lags and rolling
    statistics come from its own earlier predictions."""
    return R.recursive_forecast(_state(spark, sf), R.linear_predictor(_WEIGHTS, _CONSTANT), LC)


@register("recursive_tree_forecast", None, ops=("M3", "M11", "S6"))
def q_recursive_tree_forecast(spark, sf):
    """The submission of every item (sum of the 14 days) by second-order trees (the reference's 50 rounds) that predict a
    day from the days before, fitted on the whole history."""
    one = replace(LC, split_date=LC.test_end)
    table = E1.feature_table(_li(spark, sf), FX.items(spark, sf), one).select("qty_sold", *R.RECURSIVE_FEATURES)  # written by the fit
    days = R.recursive_forecast(_state(spark, sf), R.tree_predictor(table), LC)
    return days.groupBy("itemID").agg(F.rint(F.sum("prediction")).cast("long").alias("demandPrediction"))
