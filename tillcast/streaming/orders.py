"""Orders as a file stream, and daily item totals over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast import schemas
from tillcast.sources.files import PIPE


def read_orders_stream(spark: SparkSession, path: str,
                       max_files_per_trigger: int | None = None) -> DataFrame:
    """S1 as a stream: pipe-separated order files arriving in ``path``."""
    reader = (spark.readStream.schema(schemas.ORDERS).option("sep", PIPE)
              .option("header", True)
              .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.csv(path)


def daily_totals_stream(orders: DataFrame, late: str = "2 days") -> DataFrame:
    """Units, value and min / max / mean price per (item, day), zero prices removed.

    Days are event-time windows of ``time``; the watermark lets Spark drop the
    state of a day once orders ``late`` behind the newest one no longer count,
    so state stays bounded by the open days x items. In append mode a day is
    emitted once, when it closes.
    """
    o = orders.where(~F.equal_null(F.col("salesPrice"), F.lit(0))) \
        .withColumn("_t", F.col("time").cast("timestamp"))
    agg = (o.withWatermark("_t", late)
           .groupBy(F.window("_t", "1 day").alias("w"), "itemID")
           .agg(F.sum("order").cast("long").alias("qty_sold"),
                F.coalesce(F.sum(F.col("order") * F.col("salesPrice")), F.lit(0.0))
                .alias("sales_value"),
                F.min("salesPrice").alias("dayMinPrice"),
                F.max("salesPrice").alias("dayMaxPrice"),
                F.avg("salesPrice").alias("dayMeanPrice"),
                F.count("*").alias("n_lines")))
    return agg.select(F.to_date(F.col("w").start).alias("date"), "itemID", "qty_sold",
                      "sales_value", "dayMinPrice", "dayMaxPrice", "dayMeanPrice", "n_lines")
