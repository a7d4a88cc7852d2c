"""Daily demand per item (A1-A3) and the promotion / per-transaction aggregates.

Order lines are reduced to the (split, item, day) grain first: Spark combines
map-side, so a hot item sends at most one row per day and map task through the
shuffle. Every item-level statistic afterwards is a window over that daily
grain, where one item has at most as many rows as the calendar has days.

Two identities keep the line-level flags out of the plan:

* a day has a promoted line (price below the item maximum) exactly when the
  day's minimum price is below the item maximum;
* the item maximum is the maximum of the daily maxima.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcast.functions import (MEAN_OF_MONEY, exact_sum, iso_week, line_weight, month_day,
                                round2, safe_div, week_of_month_eda, weekday_mon1)
from tillcast.operators.grid import item_partitions
from tillcast.operators.prepare import spread_join

ITEM = ["split", "itemID"]
DAY = ["split", "itemID", "date"]


def _item_window(keys=ITEM) -> Window:
    return Window.partitionBy(*keys)


def day_totals(txn: DataFrame, keys=DAY) -> DataFrame:
    """(split, item, day) totals: units, value, min/max/mean line price, lines."""
    n, price = line_weight(txn), F.col("salesPrice")
    return txn.groupBy(*keys).agg(
        F.sum(F.col("order") * n).cast("long").alias("qty_sold"),
        F.coalesce(exact_sum(F.col("order") * price * n), F.lit(0.0)).alias("sales_value"),
        F.min("salesPrice").alias("dayMinPrice"),
        F.max("salesPrice").alias("dayMaxPrice"),
        safe_div(exact_sum(price * n), F.sum(F.when(price.isNotNull(), n))).alias("dayMeanPrice"),
        F.sum(n).cast("long").alias("n_lines"))


def daily_sales(txn: DataFrame, median_disc: DataFrame | None = None,
                price_basis: str = "price", partitions: int | None = None) -> DataFrame:
    """A1 + A2 + W5: the daily table of the feature pipeline.

    Columns: split, date, itemID, qty_sold, sales_value, promotion,
    maxItemPrice, minItemPrice, PricePerEachToday, Price, PriceToday,
    medianDiscPerc.

    ``price_basis="price"`` (default): ``PriceToday`` is the mean line price of
    the day and ``Price`` the item mean of it. ``price_basis="revenue"``:
    ``PriceToday`` is the day's sales value and ``Price`` its item mean.

    The daily rows are hash-partitioned by item into ``partitions`` (default:
    :func:`~tillcast.operators.grid.item_partitions`). Every later per-item step (item windows,
    joins with item-level tables, grid expansion, series windows) reuses this
    partitioning. The count is explicit because the grid expands each daily row
    many times over: sizing partitions by the daily shuffle bytes, as adaptive
    coalescing does, would leave the expanded grid in too few tasks.
    """
    if price_basis not in ("price", "revenue"):
        raise ValueError("price_basis must be 'price' or 'revenue'")
    w = _item_window()
    day = day_totals(txn).repartition(partitions or item_partitions(txn), "itemID")
    max_item = F.max("dayMaxPrice").over(w)
    today = F.col("dayMeanPrice") if price_basis == "price" else F.col("sales_value")
    out = (day
           .withColumn("maxItemPrice", max_item)
           .withColumn("minItemPrice", F.min("dayMinPrice").over(w))
           .withColumn("promotion",
                       F.coalesce((F.col("dayMinPrice") < F.col("maxItemPrice")).cast("int"),
                                  F.lit(0)))
           .withColumn("PricePerEachToday", round2(safe_div(F.col("sales_value"),
                                                           F.col("qty_sold"))))
           .withColumn("PriceToday", today)
           .withColumn("Price", round2(safe_div(
               F.sum(today.cast(MEAN_OF_MONEY)).over(w).cast("double"), F.count(today).over(w)))))
    if median_disc is not None:
        out = out.join(median_disc.select("itemID", "medianDiscPerc"), "itemID", "left")
    else:
        out = out.withColumn("medianDiscPerc", F.lit(None).cast("double"))
    return out.select("split", "date", "itemID", "qty_sold", "sales_value", "promotion",
                      "maxItemPrice", "minItemPrice", "PricePerEachToday", "Price",
                      "PriceToday", "medianDiscPerc")


# --- A3 and the exploration "results" table (J6, F4, F6, F7, F9, P17) ---------------

def eda_daily(txn: DataFrame) -> DataFrame:
    """A3: per (date, item): units, unweighted mean of ``salesPrice / order``,
    ``in_promotion`` (price below the whole-period item maximum on any line).

    ``txn`` is the exploration input: positive prices, no split.
    """
    n = line_weight(txn)
    each = safe_div(F.col("salesPrice"), F.col("order"))
    day = txn.groupBy("date", "itemID").agg(
        F.sum(F.col("order") * n).cast("long").alias("order"),
        safe_div(F.sum(each * n), F.sum(F.when(each.isNotNull(), n))).alias("weightedAveragePrice"),
        F.min("salesPrice").alias("_min"), F.max("salesPrice").alias("_max"))
    w = Window.partitionBy("itemID")
    flag = F.coalesce(F.col("_min") < F.max("_max").over(w), F.lit(False))
    return day.select("date", "itemID", "order", "weightedAveragePrice",
                      flag.alias("in_promotion"))


def eda_results(txn: DataFrame, items: DataFrame) -> DataFrame:
    """Exploration results: A3 + item data by key (J6) + rating flag (P17) +
    discount to retail price (F4) + weekday, day, ISO week, week of month (F6, F7, F9)."""
    it = items.withColumn("customerRatingIndicator", F.col("customerRating") == 0)
    res = eda_daily(txn).join(it, "itemID", "left")
    return (res
            .withColumn("recommendedRetailPriceDiscount",
                        safe_div(F.col("weightedAveragePrice") - F.col("recommendedRetailPrice"),
                                 F.col("recommendedRetailPrice")))
            .withColumn("weekDay", weekday_mon1("date"))
            .withColumn("day", month_day("date"))
            .withColumn("week", iso_week("date"))
            .withColumn("weekOfMonth", week_of_month_eda("date")))


# --- A8-A11: promotion effect on units ------------------------------------------------

def price_level_days(txn: DataFrame) -> DataFrame:
    """(split, item, day, price) units and line counts, with the line promotion flag.

    The flag compares the price with the item maximum, a grouped maximum
    joined to this grain (days x price levels per item).
    """
    n = line_weight(txn)
    lvl = txn.groupBy("split", "itemID", "date", "salesPrice").agg(
        F.sum(F.col("order") * n).cast("long").alias("units"), F.sum(n).cast("long").alias("lines"))
    top = lvl.groupBy(*ITEM).agg(F.max("salesPrice").alias("_top"))
    return spread_join(lvl, top, ITEM).withColumn(
        "promotion", F.coalesce((F.col("salesPrice") < F.col("_top")).cast("int"), F.lit(0))).drop("_top")


def units_by_promotion_day(txn: DataFrame) -> DataFrame:
    """Units per (split, item, day, promotion flag)."""
    return (price_level_days(txn).groupBy("split", "itemID", "date", "promotion")
            .agg(F.sum("units").cast("long").alias("order")))


def promotion_summary(txn: DataFrame) -> DataFrame:
    """A9 + A10: per item units and sale days with / without promotion (0 when
    absent) and units per sale day (0 when there is no such day)."""
    d = units_by_promotion_day(txn)
    promo = F.col("promotion") == 1
    s = d.groupBy("split", "itemID").agg(
        F.sum(F.when(~promo, F.col("order")).otherwise(0)).cast("long").alias("QTY_no_promo"),
        F.sum(F.when(promo, F.col("order")).otherwise(0)).cast("long").alias("QTY_promo"),
        # a row a day and flag: days are counted without gathering them
        F.count(F.when(~promo, F.col("date"))).alias("count_days_no_promo"),
        F.count(F.when(promo, F.col("date"))).alias("count_days_promo"))
    per_day = lambda q, n: F.when(F.col(n) > 0, F.col(q) / F.col(n)).otherwise(F.lit(0.0))
    return (s.withColumn("QTY_no_promo_per_day", per_day("QTY_no_promo", "count_days_no_promo"))
            .withColumn("QTY_promo_per_day", per_day("QTY_promo", "count_days_promo")))


def promotion_uplift_share(summary: DataFrame) -> DataFrame:
    """Share of items that sell more units per day on promotion."""
    return summary.groupBy("split").agg(
        F.avg((F.col("QTY_promo_per_day") > F.col("QTY_no_promo_per_day")).cast("double"))
        .alias("uplift_share"))


# --- A12 ------------------------------------------------------------------------------

def item_daily_stats(grid: DataFrame) -> DataFrame:
    """Per item mean daily units and median of the distinct daily unit values,
    both rounded to 2. Grouping by (item, units) first keeps each group tiny."""
    by_value = grid.groupBy("split", "itemID", "qty_sold").agg(F.count("*").alias("n_days"))
    return by_value.groupBy("split", "itemID").agg(
        round2(F.sum(F.col("qty_sold") * F.col("n_days")) / F.sum("n_days"))
        .alias("avg_daily_orders"),
        round2(F.median("qty_sold")).alias("median_daily_orders_unique"))


# --- A13, A14 -------------------------------------------------------------------------

def per_transaction_by_promotion(lines: DataFrame, flag: str = "in_promotion",
                                 qty: str = "order", price: str = "salesPrice") -> DataFrame:
    """A13 + A14 on rows of the daily results table (``price = weightedAveragePrice``):
    per promotion flag, revenue per row and units per row."""
    return lines.groupBy(flag).agg(
        (F.sum(F.col(qty) * F.col(price)) / F.count("*")).alias("revenue_per_row"),
        (F.sum(qty) / F.count("*")).alias("units_per_row"),
        F.count("*").alias("n_rows"))


def per_line_by_promotion(levels: DataFrame) -> DataFrame:
    """A13 + A14 on order lines, from price levels (:func:`prepare.price_levels`
    with keys ``["itemID"]``): revenue and units per line, by whole-period flag."""
    flag = (F.col("promotion") == 1).alias("in_promotion")
    return levels.groupBy(flag).agg(
        (F.sum("value") / F.sum("lines")).alias("revenue_per_row"),
        (F.sum("units") / F.sum("lines")).alias("units_per_row"),
        F.sum("lines").alias("n_rows"))
