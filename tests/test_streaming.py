"""The streaming daily totals equal the batch daily totals of closed days."""

import datetime as dt
import os

from pyspark.sql import functions as F

from tillcast.operators import daily as D
from tillcast.operators import prepare as P
from tillcast.sources.fixtures import EVENTS_CALENDAR, event_transactions
from tillcast.streaming import daily_totals_stream, read_orders_stream

from conftest import SF_SMALL


def test_daily_totals_stream_matches_batch(spark, tmp_dir):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    txn = event_transactions(spark, SF_SMALL)
    src = os.path.join(tmp_dir, "in")
    # two files: the stream sees the second one in a later micro-batch
    first = txn.where(F.col("time") < F.lit("2024-01-16").cast("timestamp_ntz"))
    second = txn.where(F.col("time") >= F.lit("2024-01-16").cast("timestamp_ntz"))
    for i, part in enumerate((first, second)):
        (part.coalesce(1).write.option("sep", "|").option("header", True)
         .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(os.path.join(src, f"p{i}")))
    stream = read_orders_stream(spark, os.path.join(src, "*"), max_files_per_trigger=1)
    q = (daily_totals_stream(stream, "1 day").writeStream.outputMode("append")
         .format("memory").queryName("daily_stream_test")
         .option("checkpointLocation", os.path.join(tmp_dir, "ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = spark.table("daily_stream_test")
    batch = D.day_totals(P.drop_zero_prices(P.add_split(txn, EVENTS_CALENDAR)),
                         keys=["itemID", "date"])
    # days closed by the watermark (newest event minus one day) must match exactly
    newest = txn.agg(F.max("time")).first()[0]
    closed = (newest - dt.timedelta(days=1)).date()
    want = batch.where(F.col("date") < F.lit(closed))
    cols = ["date", "itemID", "qty_sold", "n_lines", "dayMinPrice", "dayMaxPrice"]
    a = sorted(map(tuple, got.where(F.col("date") < F.lit(closed)).select(*cols).collect()))
    b = sorted(map(tuple, want.select(*cols).collect()))
    assert len(a) > 0 and a == b
