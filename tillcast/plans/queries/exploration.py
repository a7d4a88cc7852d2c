"""Exploration results, per-transaction measures and promotion effects."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillcast.operators import daily as D
from tillcast.operators import prepare as P
from tillcast.plans import features as E1
from tillcast.plans import oracle as O
from tillcast.plans.registry import register
from tillcast.sources import fixtures as FX
from tillcast.plans.queries.common import (
    EC, EDA_CTES, LC, LINES_CTES, _eda_txn, _ev, _li, _train)


# --- exploration results and per-transaction measures (A3, A13, A14, J6, F4-F9) ----------

@register("eda_results", O.with_(*EDA_CTES) + "SELECT * FROM res",
          fuzz=("weightedAveragePrice", "recommendedRetailPriceDiscount"),
          ops=("A3", "J6", "F4", "F6", "F7", "F9", "P4", "P6", "P9", "P17", "W1"))
def q_eda_results(spark, sf):
    """Exploration results table: daily units, mean unit price, promotion, item data,
    rating flag, discount to retail price, calendar fields."""
    return D.eda_results(_eda_txn(spark, sf), FX.items(spark, sf)).drop("split")


@register("per_txn_by_promotion", O.with_(*EDA_CTES) + """SELECT in_promotion,
  sum("order" * salesPrice) / count(*) AS revenue_per_row, sum("order") / count(*) AS units_per_row,
  count(*) AS n_rows FROM eda GROUP BY in_promotion""",
          fuzz=("revenue_per_row", "units_per_row"), ops=("A13", "A14"))
def q_per_txn_by_promotion(spark, sf):
    """Revenue and units per order line, by promotion flag."""
    return D.per_line_by_promotion(P.price_levels(_eda_txn(spark, sf), keys=["itemID"]))


@register("per_day_by_promotion", O.with_(*EDA_CTES) + """SELECT in_promotion,
  sum("order" * weightedAveragePrice) / count(*) AS revenue_per_row,
  sum("order") / count(*) AS units_per_row, count(*) AS n_rows FROM res GROUP BY in_promotion""",
          fuzz=("revenue_per_row", "units_per_row"), ops=("A13", "A14"))
def q_per_day_by_promotion(spark, sf):
    """Revenue and units per daily row of the exploration results, by promotion flag."""
    res = D.eda_results(_eda_txn(spark, sf), FX.items(spark, sf))
    return D.per_transaction_by_promotion(res, price="weightedAveragePrice")




# --- promotion effect (A8-A12) -------------------------------------------------------------

PROMO_SQL = """dq AS (
  SELECT split, itemID, date, promotion, CAST(sum("order") AS BIGINT) AS "order"
  FROM lines WHERE split = 'train' GROUP BY split, itemID, date, promotion),
ps0 AS (
  SELECT split, itemID,
    CAST(coalesce(sum("order") FILTER (WHERE promotion = 0), 0) AS BIGINT) AS QTY_no_promo,
    CAST(coalesce(sum("order") FILTER (WHERE promotion = 1), 0) AS BIGINT) AS QTY_promo,
    count(DISTINCT date) FILTER (WHERE promotion = 0) AS count_days_no_promo,
    count(DISTINCT date) FILTER (WHERE promotion = 1) AS count_days_promo
  FROM dq GROUP BY split, itemID),
ps AS (
  SELECT *,
    CASE WHEN count_days_no_promo > 0 THEN QTY_no_promo / count_days_no_promo ELSE 0.0 END AS QTY_no_promo_per_day,
    CASE WHEN count_days_promo > 0 THEN QTY_promo / count_days_promo ELSE 0.0 END AS QTY_promo_per_day
  FROM ps0)"""


@register("units_by_promotion_day", O.with_(*LINES_CTES, PROMO_SQL) + "SELECT * FROM dq",
          ops=("A8",))
def q_units_by_promotion_day(spark, sf):
    """Train units per (item, day, line promotion flag)."""
    return D.units_by_promotion_day(_train(spark, sf))


@register("promotion_summary", O.with_(*LINES_CTES, PROMO_SQL) + "SELECT * FROM ps",
          fuzz=("QTY_no_promo_per_day", "QTY_promo_per_day"), ops=("A9", "A10"))
def q_promotion_summary(spark, sf):
    """Per item units and sale days with / without promotion, units per sale day."""
    return D.promotion_summary(_train(spark, sf))


@register("promotion_uplift", O.with_(*LINES_CTES, PROMO_SQL)
          + "SELECT split, avg(CAST(QTY_promo_per_day > QTY_no_promo_per_day AS DOUBLE)) AS uplift_share FROM ps GROUP BY split",
          fuzz=("uplift_share",), ops=("A11",))
def q_promotion_uplift(spark, sf):
    """Share of items selling more units per day on promotion."""
    return D.promotion_uplift_share(D.promotion_summary(_train(spark, sf)))


@register("item_daily_stats", O.with_(*O.pipeline_ctes(O.LINEITEM, "grid"), f"""ids AS (
  SELECT a.split, a.itemID, {O.r2('a.m')} AS avg_daily_orders, {O.r2('b.md')} AS median_daily_orders_unique
  FROM (SELECT split, itemID, avg(qty_sold) AS m FROM grid WHERE split = 'train' GROUP BY split, itemID) a
  JOIN (SELECT split, itemID, median(qty_sold) AS md
        FROM (SELECT DISTINCT split, itemID, qty_sold FROM grid WHERE split = 'train')
        GROUP BY split, itemID) b ON a.split = b.split AND a.itemID = b.itemID)""")
          + "SELECT * FROM ids", ops=("A12",))
def q_item_daily_stats(spark, sf):
    """Per item mean daily units and median of distinct daily units (train grid)."""
    return D.item_daily_stats(E1.grid_table(_li(spark, sf), LC).where(F.col("split") == "train"))


@register("promotion_summary_events",
          O.with_(*O.pipeline_ctes(O.EVENTS, "lines"), PROMO_SQL) + "SELECT * FROM ps",
          fuzz=("QTY_no_promo_per_day", "QTY_promo_per_day"), ops=("A8", "A9", "A10"))
def q_promotion_summary_events(spark, sf):
    """Promotion summary on the events fixture, where most days mix prices."""
    tr = P.prepared_transactions(_ev(spark, sf), EC).where(F.col("split") == "train")
    return D.promotion_summary(tr)
