"""A17, wide form of any width: the date x item matrix in blocks of (item range, date range).

A table with a column per item can't be as wide as the item master. Here a block holds the cells that are not
0 of ``BLOCK_ITEMS`` items and ``BLOCK_DAYS`` days as one sorted array, so its size has a bound that doesn't grow
with the data, and an index table names each item's block and slot. A column of the matrix (all days of an item) is read
from one item range, a row (all items of a day) from one date range; both filters reach the Parquet scan.

Cases: days outside the calendar are no part of the matrix; an item sold only outside it has a slot
and an empty column; an item that is not in the index has no column; a NULL item is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.operators.categories import numbered
from tillcast.operators.grid import every_day, sold_days
from tillcast.sources.fixtures import Calendar

BLOCK_ITEMS = 256
BLOCK_DAYS = 64


def _day(cal: Calendar, date: Column) -> Column:
    return F.date_diff(date, F.lit(cal.train_start).cast("date"))


def write_blocks(txn: DataFrame, cal: Calendar, path: str, items: int = BLOCK_ITEMS, days: int = BLOCK_DAYS) -> None:
    """Writes the index (itemID, item_block, slot) and the blocks of the order lines under ``path``. Blocks are sorted by
    their item range, so a column reads few row groups, and lie in a folder per date range, whose number the
    calendar bounds."""
    cells = sold_days(txn.where(F.col("itemID").isNotNull()))
    spark = txn.sparkSession
    index = numbered(cells.select("itemID").distinct().withColumn("_all", F.lit(0)), [F.col("itemID")], "_all").select(
        "itemID", F.floor(F.col("index") / items).cast("int").alias("item_block"), (F.col("index") % items).cast("int").alias("slot"))
    index.write.parquet(f"{path}/index")
    first, last = (F.lit(x).cast("date") for x in (cal.train_start, cal.test_end))
    day = _day(cal, F.col("date"))
    dealt = (cells.where(F.col("date").between(first, last)).join(spark.read.parquet(f"{path}/index"), "itemID")
             .withColumns({"date_block": F.floor(day / days).cast("int"), "day": (day % days).cast("int")}))
    blocks = dealt.groupBy("date_block", "item_block").agg(
        F.sort_array(F.collect_list(F.struct("slot", "day", "total_orders", "total_values"))).alias("cells"))
    (blocks.repartitionByRange("date_block", "item_block").sortWithinPartitions("date_block", "item_block")
     .write.partitionBy("date_block").parquet(f"{path}/blocks"))


def _tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    blocks = spark.read.schema(
        "item_block int, cells array<struct<slot:int,day:int,total_orders:bigint,total_values:double>>, date_block int"
    ).parquet(f"{path}/blocks")
    return spark.read.schema("itemID long, item_block int, slot int").parquet(f"{path}/index"), blocks


def matrix_column(spark: SparkSession, path: str, item_id: int, cal: Calendar, days: int = BLOCK_DAYS) -> DataFrame:
    """itemID, date, total_orders, total_values of an item on every day of the calendar, gaps 0."""
    index, blocks = _tables(spark, path)
    at = index.where(F.col("itemID") == item_id).first()  # one row
    item_block, slot = (at["item_block"], at["slot"]) if at else (-1, -1)
    first, last = (F.lit(x).cast("date") for x in (cal.train_start, cal.test_end))
    mine = blocks.where(F.col("item_block") == item_block).select("date_block", F.inline(
        F.filter("cells", lambda c: c["slot"] == slot)))
    sold = mine.agg(F.array_sort(F.collect_list(F.struct(
        F.date_add(first, F.col("date_block") * days + F.col("day")).alias("date"),
        F.struct("total_orders", "total_values").alias("m")))).alias("_sold"))  # a row of at most the calendar's days
    return _filled(sold.where(F.lit(at is not None)).select(
        F.lit(item_id).cast("long").alias("itemID"), F.inline(every_day("_sold", first, last))), F.col("m"))


def matrix_row(spark: SparkSession, path: str, date: str, cal: Calendar, days: int = BLOCK_DAYS) -> DataFrame:
    """itemID, date, total_orders, total_values of every item on a day, 0 where it wasn't sold."""
    import datetime as dt
    index, blocks = _tables(spark, path)
    number = (dt.date.fromisoformat(date) - dt.date.fromisoformat(cal.train_start)).days
    today = blocks.where(F.col("date_block") == number // days).select("item_block", F.inline(
        F.filter("cells", lambda c: c["day"] == number % days)))
    found = today.select("item_block", "slot", F.struct("total_orders", "total_values").alias("m"))
    return _filled(index.join(found, ["item_block", "slot"], "left")
                   .withColumn("date", F.lit(date).cast("date")), F.col("m"))


def _filled(cells: DataFrame, m: Column) -> DataFrame:
    return cells.select("itemID", "date", F.coalesce(m["total_orders"], F.lit(0).cast("long")).alias("total_orders"),
                        F.coalesce(m["total_values"], F.lit(0.0)).alias("total_values"))
