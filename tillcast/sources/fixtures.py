"""Retail views over the supplied parquet tables, and the calendars that go with them.

The retail inputs (orders, items, infos) are derived from the TPC-H-like tables:
``lineitem`` x ``part`` gives transactions, ``part`` gives item master data and
simulation infos, and ``events`` gives a second, dense set of transactions with
times of day and several prices per day. The calendar of the lineitem view is
the retail calendar moved back by 20 years.
"""

from __future__ import annotations

from dataclasses import dataclass
import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.functions import round2


@dataclass(frozen=True)
class Calendar:
    """Train range, test range and forecast period of one data set."""

    train_start: str
    split_date: str          # last train day; test starts the day after
    test_end: str
    forecast_start: str
    horizon: int = 14        # days of the forecast and of the value score

    @property
    def test_start(self) -> str:
        d = dt.date.fromisoformat(self.split_date) + dt.timedelta(days=1)
        return d.isoformat()

    @property
    def score_end(self) -> str:
        """Last day of the actual demand used for scoring (first ``horizon`` test days)."""
        d = dt.date.fromisoformat(self.test_start) + dt.timedelta(days=self.horizon - 1)
        return d.isoformat()

    @property
    def forecast_end(self) -> str:
        d = dt.date.fromisoformat(self.forecast_start) + dt.timedelta(days=self.horizon - 1)
        return d.isoformat()


# The retail calendar (2018-01-01..06-08 train, 06-09..06-29 test,
# forecast from 06-30) moved back 20 years for lineitem, and the events calendar.
LINEITEM_CALENDAR = Calendar("1998-01-01", "1998-06-08", "1998-06-29", "1998-06-30")
# A calendar over all days of lineitem, for whole-table queries that need days or a split.
LINEITEM_DAYS = Calendar("1995-01-01", "2000-12-31", "2001-12-31", "2002-01-01")
EVENTS_CALENDAR = Calendar("2024-01-01", "2024-01-20", "2024-01-30", "2024-01-31")

# Fixed values of the fixture view: every 500th order key is sold at price 0.
ZERO_PRICE_EVERY = 500
# Fixed values of the infos view: promotion dates by item key.
PROMO_TWO_DATES = "1998-06-30,1998-07-05"
PROMO_ONE_DATE = "1998-07-01"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _lineitem(spark: SparkSession, sf_dir: str, cal: Calendar | None) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_shipdate")
    if cal is None:
        return li
    start = F.lit(cal.train_start).cast("timestamp_ntz")
    end = F.date_add(F.lit(cal.test_end).cast("date"), 1).cast("timestamp_ntz")
    return li.where((F.col("l_shipdate") >= start) & (F.col("l_shipdate") < end))


def _free() -> Column:
    return F.col("l_orderkey") % ZERO_PRICE_EVERY == 0


def _priced(li: DataFrame, part: DataFrame, free: Column, *more: str) -> DataFrame:
    price = F.when(free, F.lit(0.0)).otherwise(
        round2(F.col("p_retailprice") * (1 - F.col("l_discount"))))
    return (li.join(part.select("p_partkey", "p_retailprice"), li.l_partkey == part.p_partkey)
            .select(F.col("l_shipdate").cast("timestamp_ntz").alias("time"),
                    F.col("l_partkey").alias("itemID"),
                    F.col("l_quantity").cast("int").alias("order"),
                    price.alias("salesPrice"), *more))


def transactions(spark: SparkSession, sf_dir: str,
                 cal: Calendar | None = LINEITEM_CALENDAR) -> DataFrame:
    """Orders view: one row per lineitem (shipped inside the calendar, if one is given).

    Unit price is the retail price after the line discount (rounded to cents);
    lines of every 500th order carry price 0.
    """
    return _priced(_lineitem(spark, sf_dir, cal), _table(spark, sf_dir, "part"), _free())


def transaction_kinds(spark: SparkSession, sf_dir: str,
                      cal: Calendar | None = LINEITEM_CALENDAR) -> DataFrame:
    """The orders view with equal lines counted: one row per (time, item, order,
    price) and its number of ``lines``.

    Lines are counted per (part, day, quantity, discount, free) before the
    price is joined: a partial aggregate, so a hot part sends at most one row
    per kind and task to the shuffle, and the join sees kinds, of which a part has
    no more than days x quantities x discounts.
    """
    kinds = _lineitem(spark, sf_dir, cal).groupBy(
        "l_partkey", "l_shipdate", "l_quantity", "l_discount", _free().alias("free")).agg(
        F.count("*").alias("lines"))
    return _priced(kinds, _table(spark, sf_dir, "part"), F.col("free"), "lines")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item master view over ``part``."""
    brand = F.regexp_extract("p_brand", r"#([0-9]+)", 1).cast("int")
    return _table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("itemID"),
        brand.alias("brand"),
        (brand % 5).alias("manufacturer"),
        (F.col("p_size") % 6).cast("double").alias("customerRating"),
        F.col("p_type").alias("category1"),
        (F.col("p_size") % 10).alias("category2"),
        F.split("p_name", " ").getItem(0).alias("category3"),
        F.col("p_retailprice").alias("recommendedRetailPrice"))


def infos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulation infos view over ``part``: price and promotion dates."""
    key = F.col("p_partkey")
    promo = (F.when(key % 10 == 0, F.lit(PROMO_TWO_DATES))
             .when(key % 4 == 0, F.lit(PROMO_ONE_DATE)))
    return _table(spark, sf_dir, "part").select(
        key.alias("itemID"), F.col("p_retailprice").alias("simulationPrice"),
        promo.alias("promotion"))


def event_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense fixture: every event is one unit of item ``user_id`` at price ``value``."""
    return _table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp_ntz").alias("time"),
        F.col("user_id").alias("itemID"),
        F.lit(1).alias("order"),
        F.col("value").alias("salesPrice"))


def event_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item master for the events fixture: one row per user, attributes from event types."""
    ev = _table(spark, sf_dir, "events")
    return (ev.groupBy(F.col("user_id").alias("itemID"))
            .agg(F.min("event_type").alias("category1"),
                 F.max("event_type").alias("category3"),
                 F.max("value").alias("recommendedRetailPrice"))
            .select("itemID",
                    (F.col("itemID") % 7).cast("int").alias("brand"),
                    (F.col("itemID") % 3).cast("int").alias("manufacturer"),
                    (F.col("itemID") % 6).cast("double").alias("customerRating"),
                    "category1",
                    (F.col("itemID") % 10).cast("int").alias("category2"),
                    "category3", "recommendedRetailPrice"))


def event_infos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Infos for the events fixture, built from the item view."""
    return event_items(spark, sf_dir).select(
        "itemID", F.col("recommendedRetailPrice").alias("simulationPrice"),
        F.when(F.col("itemID") % 4 == 0, F.lit("2024-01-31")).alias("promotion"))
