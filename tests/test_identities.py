"""The rewrites the plans rely on equal the direct line-level forms."""

import pytest
from pyspark.sql import functions as F

from tillcast.operators import daily as D
from tillcast.operators import prepare as P
from tillcast.operators import profile as PR
from tillcast.session import checkpoint_dir
from tillcast.sources import fixtures as FX

from conftest import SF_MID


@pytest.fixture(scope="module")
def lines(spark):
    return P.prepared_transactions(FX.event_transactions(spark, SF_MID), FX.EVENTS_CALENDAR)


def test_day_flag_equals_max_of_line_flags(spark, lines):
    daily = {(r.split, r.itemID, r.date): (r.promotion, r.maxItemPrice, r.minItemPrice)
             for r in D.daily_sales(lines).collect()}
    direct = (P.enrich_transactions(lines).groupBy("split", "itemID", "date")
              .agg(F.max("promotion").alias("p"), F.max("maxPrice").alias("mx"),
                   F.max("minPrice").alias("mn")).collect())
    assert len(direct) == len(daily) > 0
    for r in direct:
        assert daily[(r.split, r.itemID, r.date)] == (r.p, r.mx, r.mn)


def test_price_levels_equal_joined_lines(spark, lines):
    eda = P.positive_prices(lines)
    top = eda.groupBy("itemID").agg(F.max("salesPrice").alias("top"))
    flagged = eda.join(top, "itemID").withColumn("in_promotion", F.col("salesPrice") < F.col("top"))
    via_levels = {r.in_promotion: (r.n_rows, round(r.units_per_row, 9), round(r.revenue_per_row, 6))
                  for r in D.per_line_by_promotion(P.price_levels(eda, ["itemID"])).collect()}
    via_lines = {r.in_promotion: (r.n_rows, round(r.units_per_row, 9), round(r.revenue_per_row, 6))
                 for r in D.per_transaction_by_promotion(flagged).collect()}
    assert via_levels == via_lines
    # discount extremes: levels vs enriched lines
    a = P.discount_extremes(P.price_levels(lines)).first()
    b = P.discount_extremes(P.enrich_transactions(lines)).first()
    assert tuple(a) == tuple(b)


def test_per_item_histogram_levels_equal_lines(spark, lines):
    got = {(r.itemID, r.bin): r["count"] for r in PR.histogram_per_item(lines).collect()}
    mm = lines.groupBy("itemID").agg(F.min("salesPrice").alias("lo"), F.max("salesPrice").alias("hi"))
    j = lines.join(mm, "itemID")
    b = F.when(F.col("hi") > F.col("lo"),
               F.least(F.floor((F.col("salesPrice") - F.col("lo")) / (F.col("hi") - F.col("lo"))
                               * 10).cast("int") + 1, F.lit(10))).otherwise(F.lit(1))
    want = {(r.itemID, r.bin): r.n for r in j.groupBy("itemID", b.alias("bin"))
            .agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_checkpoint_dir_uses_session_setting(spark, tmp_dir):
    path = checkpoint_dir(spark)
    assert path
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert path == configured
