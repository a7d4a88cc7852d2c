"""M11, recursive form: one-day-ahead predictions fed back as the next day's history.

An item is one row, whose state is the array of its last ``HISTORY`` daily units. Each of the forecast days
reads its lags and rolling statistics from the array, adds a prediction, and appends it; a day is a
projection, so no day shuffles or joins anything. The rows are written after every day: a day's columns are
used many times by the next one, and a plan over several days would grow with their product.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.functions import promotion_dates
from tillcast.operators import boosting
from tillcast.operators.features import _middle, date_field_columns
from tillcast.schemas import LAGS, ROLLING_DAYS
from tillcast.session import written
from tillcast.sources.fixtures import Calendar

HISTORY = 14

#: What a day's prediction may use: all of it is known or predicted by then.
SERIES_FEATURES = [*(f"qty_sold_lag{k}" for k in LAGS), "rolling_qty_sold_mean", "rolling_qty_sold_std", "rolling_qty_sold_median"]
DAY_FEATURES = ["promotion", "weekDay", "day", "weekOfMonth"]
ITEM_FEATURES = ["customerRating", "recommendedRetailPrice"]
RECURSIVE_FEATURES = [*SERIES_FEATURES, *DAY_FEATURES, *ITEM_FEATURES]


def item_state(orders: DataFrame, items: DataFrame, infos: DataFrame, cal: Calendar) -> DataFrame:
    """One row per item of ``items``: its columns, ``_history`` (units of the last ``HISTORY`` days before the
    forecast, oldest first, 0 without orders) and ``_promo`` (planned promotion dates)."""
    last = F.lit(cal.forecast_start).cast("date")
    date = F.to_date("time")
    lines = F.col("lines") if "lines" in orders.columns else F.lit(1)
    recent = orders.where((date < last) & (date >= F.date_sub(last, HISTORY)))
    units = recent.groupBy("itemID", date.alias("date")).agg(F.sum(F.col("order") * lines).cast("double").alias("units"))
    sold = units.groupBy("itemID").agg(F.map_from_entries(F.collect_list(F.struct("date", "units"))).alias("_sold"))
    days = F.sequence(F.date_sub(last, HISTORY), F.date_sub(last, 1))
    plan = infos.select("itemID", F.coalesce(promotion_dates("promotion"), F.array().cast("array<date>")).alias("_promo"))
    return (items.join(sold, "itemID", "left").join(plan, "itemID", "left")
            .withColumn("_history", F.transform(days, lambda d: F.coalesce(F.col("_sold")[d], F.lit(0.0))))
            .withColumn("_promo", F.coalesce("_promo", F.array().cast("array<date>"))).drop("_sold"))


def series_features(history: Column) -> dict[str, Column]:
    """Lags and statistics of the last days of an array of daily units, as W6 to W8 have them."""
    last = F.slice(history, -ROLLING_DAYS, ROLLING_DAYS)
    total = F.aggregate(last, F.lit(0.0), lambda a, x: a + x)
    mean = total / ROLLING_DAYS
    square = F.transform(F.array(mean), lambda m: F.aggregate(last, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)))[0]
    return {**{f"qty_sold_lag{k}": F.element_at(history, -k) for k in LAGS}, "rolling_qty_sold_mean": mean,
            "rolling_qty_sold_std": F.sqrt(square / (ROLLING_DAYS - 1)),
            "rolling_qty_sold_median": _middle(F.array_sort(last), F.lit(ROLLING_DAYS))}


def recursive_forecast(state: DataFrame, predict: Callable[[DataFrame], DataFrame], cal: Calendar) -> DataFrame:
    """(itemID, date, prediction) for the ``cal.horizon`` days from ``cal.forecast_start``. ``predict`` adds the column
    ``prediction`` to rows with the features of a day; negative predictions count as 0."""
    start = dt.date.fromisoformat(cal.forecast_start)
    kept = state.columns
    rows = written(state.withColumn("_found", F.array().cast("array<double>")))
    for k in range(cal.horizon):
        day = F.lit(start + dt.timedelta(days=k))
        asked = rows.withColumns(series_features(F.col("_history"))).withColumn("_day", day)
        asked = asked.select("*", *date_field_columns("_day"), F.array_contains("_promo", day).cast("int").alias("promotion"))
        units = F.greatest(F.lit(0.0), F.col("prediction"))
        rows = written(predict(asked).withColumn("_units", units).withColumns({
            "_history": F.concat(F.slice("_history", 2, HISTORY - 1), F.array("_units")),
            "_found": F.concat("_found", F.array("_units"))}).select(*kept, "_found"))
    found = rows.select("itemID", F.posexplode("_found").alias("_k", "prediction"))
    return found.select("itemID", F.date_add(F.lit(start), F.col("_k")).alias("date"), "prediction")


def linear_predictor(weights: dict[str, float], constant: float = 0.0) -> Callable[[DataFrame], DataFrame]:
    """A fixed linear predictor on the features of a day."""
    def predict(df: DataFrame) -> DataFrame:
        total = F.lit(constant)
        for name, w in weights.items():
            total = total + F.lit(w) * F.col(name)
        return df.withColumn("prediction", total)
    return predict


def tree_predictor(features: DataFrame, rounds: int = boosting.ROUNDS, **params) -> Callable[[DataFrame], DataFrame]:
    """Boosted trees of the next day's units, fitted on the rows of a feature table."""
    model = boosting.fit(features, RECURSIVE_FEATURES, "qty_sold", rounds=rounds, **params)
    return model.predict_batches
