"""Fixture inputs and SQL fragments shared by the query modules."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tillcast.operators import daily as D
from tillcast.operators import prepare as P
from tillcast.operators import profile as PR
from tillcast.plans import features as E1
from tillcast.plans import oracle as O
from tillcast.sources import fixtures as FX

LC = FX.LINEITEM_CALENDAR
EC = FX.EVENTS_CALENDAR

# float columns of the feature table whose last bits depend on summation order
FEATURE_FUZZ = ("harmonic_0", "harmonic_1", "harmonic_2", "harmonic_3", "harmonic_4",
                "rolling_qty_sold_mean", "rolling_qty_sold_std", ("sales_value_lag1", 2),
                ("sales_value_lag2", 2), ("sales_value_lag3", 2), ("sales_value_lag7", 2))


DC = FX.LINEITEM_DAYS


def _li(spark, sf):
    """Order lines of the retail calendar, equal ones counted."""
    return FX.transaction_kinds(spark, sf, LC)


def _ev(spark, sf):
    return FX.event_transactions(spark, sf)


def _every(spark, sf):
    """All order lines, equal ones counted."""
    return FX.transaction_kinds(spark, sf, None)


def _prep(spark, sf):
    return P.prepared_transactions(_every(spark, sf), DC)


def _train(spark, sf):
    return _prep(spark, sf).where(F.col("split") == "train")


def _eda_txn(spark, sf):
    """Exploration input: all orders with a positive price, with date."""
    return P.positive_prices(P.add_split(_every(spark, sf), DC))


def _all_txn(spark, sf):
    """All orders with date (no price filter), as in the matrix notebook."""
    return P.add_split(_every(spark, sf), DC)


#: All days of lineitem, split after the first quarter, so that some items are sold in test only.
QUARTER = replace(DC, split_date="1995-03-31")


def _split_txn(spark, sf):
    """All orders, split after the first quarter."""
    return P.add_split(_every(spark, sf), QUARTER)


EDA_SQL = f"""eda AS (
  SELECT itemID, "order", salesPrice, time, CAST(time AS DATE) AS date,
         salesPrice < max(salesPrice) OVER (PARTITION BY itemID) AS in_promotion
  FROM txn WHERE salesPrice > 0),
res0 AS (
  SELECT date, itemID, CAST(sum("order") AS BIGINT) AS "order",
         avg(salesPrice / nullif("order", 0)) AS weightedAveragePrice,
         bool_or(in_promotion) AS in_promotion
  FROM eda GROUP BY date, itemID),
res AS (
  SELECT r.*, i.brand, i.manufacturer, i.customerRating, i.category1, i.category2,
         i.category3, i.recommendedRetailPrice,
         i.customerRating = 0 AS customerRatingIndicator,
         (r.weightedAveragePrice - i.recommendedRetailPrice) / nullif(i.recommendedRetailPrice, 0)
           AS recommendedRetailPriceDiscount,
         CAST(isodow(r.date) AS INT) AS weekDay, CAST(day(r.date) AS INT) AS day,
         CAST(week(r.date) AS INT) AS week, {O.week_of_month('r.date', eda=True)} AS weekOfMonth
  FROM res0 r LEFT JOIN items_v i ON r.itemID = i.itemID)"""


EDA_CTES = [O.LINEITEM_ALL.txn, O.LINEITEM_ALL.items, EDA_SQL]
LINES_CTES = O.pipeline_ctes(O.LINEITEM_ALL, "lines")


def _matrix(spark, sf, mean_days=None):
    from tillcast.operators.grid import date_item_matrix
    return date_item_matrix(_all_txn(spark, sf), DC, mean_days)


MATRIX_SQL = f"""days AS (
  SELECT CAST(unnest(generate_series({O.d(DC.train_start)}, {O.d(DC.test_end)}, INTERVAL 1 DAY)) AS DATE) AS date),
tday AS (
  SELECT itemID, CAST(time AS DATE) AS date, CAST(sum("order") AS BIGINT) AS total_orders,
         coalesce({O.xsum('"order" * salesPrice')}, 0) AS total_values
  FROM txn GROUP BY itemID, CAST(time AS DATE)),
matrix AS (
  SELECT k.itemID, d.date, coalesce(t.total_orders, 0) AS total_orders,
         coalesce(t.total_values, 0) AS total_values
  FROM (SELECT DISTINCT itemID FROM tday) k JOIN days d ON TRUE
  LEFT JOIN tday t ON t.itemID = k.itemID AND t.date = d.date),
prof0 AS (
  SELECT itemID, {O.r2(O.xsum('total_values'))} AS total_value,
         count(*) FILTER (WHERE total_values IS DISTINCT FROM 0) AS n_sale_days
  FROM matrix GROUP BY itemID),
prof AS (SELECT *, total_value / nullif(n_sale_days, 0) AS avg_value_sale_day FROM prof0)"""


MATRIX_CTES = [O.LINEITEM_ALL.txn, MATRIX_SQL]


def _profile(spark, sf):
    from tillcast.operators.grid import sold_days
    # the matrix' other days are 0 in every column: they change neither totals nor sale days
    return PR.sale_day_profile(sold_days(_all_txn(spark, sf)))


def _res(spark, sf):
    return D.eda_results(_eda_txn(spark, sf), FX.items(spark, sf))


def split_sql(cal):
    return f"""sp AS (
  SELECT itemID, "order", salesPrice,
         CASE WHEN CAST(time AS DATE) <= {O.d(cal.split_date)} THEN 'train' ELSE 'test' END AS split
  FROM txn)"""


SPLIT_SQL = f"""{split_sql(QUARTER)},
lost AS (SELECT DISTINCT itemID FROM sp WHERE split = 'test'
         AND itemID NOT IN (SELECT itemID FROM sp WHERE split = 'train'))"""


GRID_CTES = O.pipeline_ctes(O.LINEITEM, "grid")


def _grid(spark, sf):
    return E1.grid_table(_li(spark, sf), LC)


def _shared_dir(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint folder of the session."""
    import uuid
    from tillcast.session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
