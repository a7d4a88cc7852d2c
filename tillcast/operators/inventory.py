"""Monetary value of a forecast and the retailer's stock limits.

Per item: forecast f, actual demand a, price p.

* value: ``p * f`` if ``f <= a``, else ``p * a - 0.6 * p * (f - a)`` (B1)
* overstock: ``max(f - a, 0)`` units and their value (B2)
* lost sales: ``max(a - f, 0)`` units and their value (B3)
* locked capital: ``f * p / 1.3``, stock at purchase cost under a 30 % markup (B4);
  ``stock_value = f * p`` is kept alongside
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.functions import exact_sum, round2
from tillcast.sources.fixtures import Calendar

# Fixed values of the brief: overstock penalty share and markup on purchase cost.
OVERSTOCK_PENALTY = 0.6
MARKUP = 1.3


def units_in_range(daily: DataFrame, first: str, last: str, name: str) -> DataFrame:
    """Units per item between two dates (inclusive)."""
    d = F.col("date")
    return (daily.where((d >= F.lit(first).cast("date")) & (d <= F.lit(last).cast("date")))
            .groupBy("itemID").agg(F.sum("qty_sold").cast("long").alias(name)))


def naive_forecast(daily: DataFrame, cal: Calendar) -> DataFrame:
    """Baseline forecast: units of the last ``horizon`` train days (lag-14 naive)."""
    first = F.date_sub(F.lit(cal.split_date).cast("date"), cal.horizon - 1)
    d = F.col("date")
    return (daily.where((d >= first) & (d <= F.lit(cal.split_date).cast("date")))
            .groupBy("itemID").agg(F.sum("qty_sold").cast("long").alias("forecast")))


def actual_demand(daily: DataFrame, cal: Calendar) -> DataFrame:
    """Actual demand: units of the first ``horizon`` test days."""
    return units_in_range(daily, cal.test_start, cal.score_end, "actual")


def score_input(items: DataFrame, forecast: DataFrame, actual: DataFrame,
                infos: DataFrame) -> DataFrame:
    """Every item with forecast, actual demand (0 when absent) and price."""
    return (items.select("itemID")
            .join(forecast.select("itemID", "forecast"), "itemID", "left")
            .join(actual.select("itemID", "actual"), "itemID", "left")
            .join(infos.select("itemID", F.col("simulationPrice").alias("price")), "itemID",
                  "left")
            .fillna({"forecast": 0, "actual": 0}))


def measures(f: Column, a: Column, p: Column) -> dict[str, Column]:
    """B1-B4 of forecast ``f``, demand ``a`` and price ``p``."""
    over = F.greatest(f - a, F.lit(0))
    lost = F.greatest(a - f, F.lit(0))
    return {"value": F.when(f <= a, p * f).otherwise(p * a - OVERSTOCK_PENALTY * p * (f - a)),
            "overstock_units": over.cast("long"), "overstock_value": over * p,
            "lost_units": lost.cast("long"), "lost_value": lost * p,
            "stock_value": f * p, "locked_capital": f * p / MARKUP}


def monetary_value(si: DataFrame, forecast: str = "forecast") -> DataFrame:
    """B1-B4 per item."""
    return si.withColumns(measures(F.col(forecast), F.col("actual"), F.col("price")))


def value_totals(scored: DataFrame, keys=()) -> DataFrame:
    """B1-B4 totals."""
    return scored.groupBy(*keys).agg(
        F.sum("value").alias("total_value"),
        F.sum("overstock_units").cast("long").alias("overstock_units"),
        F.sum("overstock_value").alias("overstock_value"),
        F.sum("lost_units").cast("long").alias("lost_units"),
        F.sum("lost_value").alias("lost_value"),
        # stock value is whole cents: round its sum to cents, then take off the markup
        (round2(F.sum("stock_value")) / MARKUP).alias("locked_capital"))


def _money(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def demand_shares(si: DataFrame, max_overstock: float, max_lost: float, max_locked: float) -> dict[str, Column]:
    """The three limits in money, from shares of the value of the demand (NULL if there is none)."""
    demand = si.agg(exact_sum(F.col("actual") * F.col("price"))).scalar()
    return {"max_overstock": F.lit(float(max_overstock)) * demand, "max_lost": F.lit(float(max_lost)) * demand,
            "max_locked": F.lit(float(max_locked)) * demand}


def constraint_check(totals: DataFrame, max_overstock, max_lost, max_locked) -> DataFrame:
    """Compare totals with the retailer's three limits (values in money, or columns of them)."""
    ok_o = F.col("overstock_value") <= _money(max_overstock)
    ok_l = F.col("lost_value") <= _money(max_lost)
    ok_c = F.col("locked_capital") <= _money(max_locked)
    return (totals.withColumn("overstock_ok", ok_o).withColumn("lost_ok", ok_l)
            .withColumn("capital_ok", ok_c).withColumn("feasible", ok_o & ok_l & ok_c))


def scenario_sweep(si: DataFrame, factors, max_overstock, max_lost, max_locked) -> DataFrame:
    """Scale every forecast by each factor (rounded half-even to units),
    total B1-B4 per factor, mark the factors within all limits, and rank the
    feasible ones by value (``best`` = rank 1).

    The factor grid is a parameter list, exploded inside each item row; the
    per-factor totals are one row per factor.
    """
    grid = F.array(*[F.lit(float(x)) for x in factors])
    scaled = (si.select("*", F.explode(grid).alias("factor"))
              .withColumn("scaled", F.rint(F.col("forecast") * F.col("factor")).cast("long")))
    totals = value_totals(monetary_value(scaled, "scaled"), ["factor"])
    checked = constraint_check(totals, max_overstock, max_lost, max_locked)
    w = Window.partitionBy("feasible").orderBy(F.desc("total_value"), F.asc("factor"))
    return checked.withColumn("best", F.col("feasible") & (F.row_number().over(w) == 1))
