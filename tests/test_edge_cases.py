"""Hand-computed edge cases (FIXTURES section 3)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillcast.functions import promotion_dates, round2, week_of_month_calendar, week_of_month_eda
from tillcast.operators import daily as D
from tillcast.operators import grid as G
from tillcast.operators import inventory as B
from tillcast.operators import prepare as P
from tillcast.operators import profile as PR
from tillcast.sources.fixtures import Calendar

CAL = Calendar("2018-01-01", "2018-01-05", "2018-01-07", "2018-01-08")
ORDERS = "time timestamp_ntz, itemID long, order int, salesPrice double"


def ts(s):
    return dt.datetime.fromisoformat(s)


def orders(spark, rows):
    return spark.createDataFrame(rows, ORDERS)


def test_null_and_zero_prices(spark):
    df = orders(spark, [(ts("2018-01-01 10:00"), 1, 1, None), (ts("2018-01-01 11:00"), 1, 1, 0.0),
                        (ts("2018-01-01 12:00"), 1, 1, 5.0)])
    kept = sorted(r.salesPrice or -1 for r in P.drop_zero_prices(df).collect())
    assert kept == [-1, 5.0]                       # NULL kept, 0 removed (pandas != 0)
    assert [r.salesPrice for r in P.positive_prices(df).collect()] == [5.0]


def test_whole_period_vs_running_max_with_tied_times(spark):
    df = P.add_split(orders(spark, [(ts("2018-01-01 09:00"), 1, 1, 10.0),
                                    (ts("2018-01-01 10:00"), 1, 1, 8.0),
                                    (ts("2018-01-01 10:00"), 1, 1, 12.0)]), CAL)
    w1 = {r.salesPrice: r.promotion for r in P.enrich_transactions(df).collect()}
    assert w1 == {10.0: 1, 8.0: 1, 12.0: 0}
    w3 = {r.salesPrice: r.in_promotion_hist for r in P.running_max_promotion(df).collect()}
    assert w3 == {10.0: 0, 8.0: 1, 12.0: 0}        # 8 and 12 are peers: max at 10:00 is 12


def test_running_max_across_buckets(spark):
    df = P.add_split(orders(spark, [(ts("2018-01-01 09:00"), 1, 1, 10.0),
                                    (ts("2018-01-02 09:30"), 1, 1, 9.0),
                                    (ts("2018-01-02 09:10"), 1, 1, 11.0),
                                    (ts("2018-01-03 23:59"), 1, 1, 11.0)]), CAL)
    got = sorted((r.time, r.runningMaxPrice) for r in P.running_max_promotion(df).collect())
    assert [m for _, m in got] == [10.0, 11.0, 11.0, 11.0]


def test_median_discount_of_distinct_levels(spark):
    rows = [(ts("2018-01-01 10:00"), 1, 1, 100.0)] + \
           [(ts("2018-01-02 10:00"), 1, 1, p) for p in (90.0, 90.0, 90.0, 70.0)] + \
           [(ts("2018-01-02 10:00"), 2, 1, 50.0)]        # item 2: never discounted
    df = P.add_split(orders(spark, rows), CAL)
    items = spark.createDataFrame([(1,), (2,), (3,)], "itemID long")
    got = {r.itemID: r.medianDiscPerc for r in P.discount_stats(items, df).collect()}
    assert got == {1: 0.2, 2: None, 3: None}
    infos = spark.createDataFrame([(1, 20.0, "2018-01-08"), (2, 30.0, "2018-01-08"),
                                   (3, 40.0, None)],
                                  "itemID long, simulationPrice double, promotion string")
    f3 = {r.itemID: r.discountedPrice for r in P.infos_with_discount(infos, items, df).collect()}
    assert f3 == {1: 16.0, 2: None, 3: None}


def test_item_sold_on_one_day_fills_grid(spark):
    df = P.prepared_transactions(orders(spark, [(ts("2018-01-03 10:00"), 7, 2, 5.0),
                                                (ts("2018-01-03 11:00"), 7, 1, 4.0)]), CAL)
    daily = D.daily_sales(df)
    grid = G.dense_grid(daily, CAL).orderBy("date").collect()
    assert len(grid) == 5                                   # train has 5 days
    assert [r.qty_sold for r in grid] == [0, 0, 3, 0, 0]
    assert {r.PricePerEachToday for r in grid} == {4.67}    # 14 / 3 rounded, filled everywhere
    assert {r.PriceToday for r in grid} == {4.5}            # mean line price
    assert [r.promotion for r in grid] == [0, 0, 1, 0, 0]   # 4 < item max 5


def test_item_only_in_test_is_lost(spark):
    df = P.add_split(orders(spark, [(ts("2018-01-02 10:00"), 1, 1, 10.0),
                                    (ts("2018-01-06 10:00"), 1, 1, 10.0),
                                    (ts("2018-01-06 10:00"), 2, 3, 10.0)]), CAL)
    assert [r.itemID for r in PR.lost_items(df).collect()] == [2]
    r = PR.lost_revenue_share(df).first()
    assert r.n_lost_items == 1 and r.lost_revenue_pct == 60.0


def test_week_of_month_sunday(spark):
    r = spark.range(1).select(F.lit("2018-06-03").cast("date").alias("d")).select(
        week_of_month_calendar("d").alias("f8"), week_of_month_eda("d").alias("f9")).first()
    assert (r.f8, r.f9) == (1, 2)


@pytest.mark.parametrize("x,want", [(0.125, 0.12), (0.135, 0.14), (845.615, 845.62),
                                    (-1.005, -1.0), (2.675, 2.68), (1.015, 1.01), (8.345, 8.35),
                                    (12345678901.235, 12345678901.24), (None, None)])
def test_round_half_even(spark, x, want):
    got = spark.createDataFrame([(x,)], "x double").select(round2("x").alias("r")).first().r
    assert got == want


def test_promotion_dates_parsing(spark):
    df = spark.createDataFrame([(1, None), (2, "2018-06-30"), (3, "2018-06-30, 2018-07-05")],
                               "itemID long, promotion string")
    got = {r.itemID: r.d for r in df.select("itemID", promotion_dates("promotion").alias("d"))
           .collect()}
    assert got[1] is None
    assert got[2] == [dt.date(2018, 6, 30)]
    assert got[3] == [dt.date(2018, 6, 30), dt.date(2018, 7, 5)]


def test_monetary_value(spark):
    si = spark.createDataFrame([(1, 5, 5, 10.0), (2, 5, 4, 10.0), (3, 5, 6, 10.0)],
                               "itemID long, forecast long, actual long, price double")
    got = {r.itemID: (r.value, r.overstock_units, r.lost_units)
           for r in B.monetary_value(si).collect()}
    assert got == {1: (50.0, 0, 0), 2: (34.0, 1, 0), 3: (50.0, 0, 1)}


def test_histogram_single_value(spark):
    df = spark.createDataFrame([(3.0,), (3.0,), (None,)], "x double")
    rows = PR.histogram(df, "x", 10).collect()
    assert [(r.bin, r["count"], r.pct) for r in rows] == [(1, 2, 100.0)]


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)], "x double")
    rows = {r.bin: r["count"] for r in PR.histogram(df, "x", 10).collect()}
    assert rows[10] == 2 and sum(rows.values()) == 11


def test_scenario_sweep_picks_best_feasible(spark):
    si = spark.createDataFrame([(1, 10, 8, 10.0)],
                               "itemID long, forecast long, actual long, price double")
    out = {r.factor: r for r in B.scenario_sweep(si, [0.5, 0.8, 1.0, 1.5], 1e9, 1e9, 1e9)
           .collect()}
    assert out[0.8].best and not out[1.0].best
    assert out[0.8].total_value == 80.0


def test_wide_matrix_and_long_matrix(spark):
    df = P.add_split(orders(spark, [(ts("2018-01-02 10:00"), 1, 2, 5.0),
                                    (ts("2018-01-02 12:00"), 1, 1, 5.0),
                                    (ts("2018-01-04 10:00"), 2, 4, 1.5)]), CAL)
    m = G.date_item_matrix(df, CAL)
    assert m.count() == 2 * 7                                  # items x calendar days
    rows = {(r.itemID, str(r.date)): (r.total_orders, r.total_values) for r in m.collect()}
    assert rows[(1, "2018-01-02")] == (3, 15.0) and rows[(2, "2018-01-02")] == (0, 0.0)
    w = {str(r.date): (r["1"], r["2"]) for r in G.wide_matrix(m, [1, 2]).collect()}
    assert w["2018-01-04"] == (0, 4) and len(w) == 7


def test_lost_items_with_repeated_lines(spark):
    rows = [(ts("2018-01-02 10:00"), 1, 1, 1.0)] * 5 + [(ts("2018-01-06 10:00"), 1, 1, 1.0)] \
        + [(ts("2018-01-06 11:00"), 3, 1, 1.0)] * 3
    df = P.add_split(orders(spark, rows), CAL)
    assert [r.itemID for r in PR.lost_items(df).collect()] == [3]


def test_item_daily_stats_median_of_distinct(spark):
    grid = spark.createDataFrame([("train", 1, 0), ("train", 1, 0), ("train", 1, 0),
                                  ("train", 1, 4), ("train", 1, 10)],
                                 "split string, itemID long, qty_sold long")
    r = D.item_daily_stats(grid).first()
    assert r.avg_daily_orders == 2.8 and r.median_daily_orders_unique == 4.0


def test_constraint_flags(spark):
    tot = spark.createDataFrame([(100.0, 10.0, 5.0, 50.0)],
                                "total_value double, overstock_value double, lost_value double, "
                                "locked_capital double")
    r = B.constraint_check(tot, max_overstock=10.0, max_lost=4.0, max_locked=60.0).first()
    assert (r.overstock_ok, r.lost_ok, r.capital_ok, r.feasible) == (True, False, True, False)


def test_several_price_share(spark):
    df = P.add_split(orders(spark, [(ts("2018-01-02 10:00"), 1, 1, 5.0),
                                    (ts("2018-01-02 11:00"), 1, 1, 4.0),
                                    (ts("2018-01-03 10:00"), 1, 1, 5.0)]), CAL)
    items = spark.createDataFrame([(1,), (2,), (3,), (4,)], "itemID long")
    r = P.several_price_share(df, items).first()
    assert (r.multi_pairs, r.all_pairs, r.n_items) == (1, 2, 4)
    assert (r.pairs_per_item_pct, r.pairs_share_pct) == (25.0, 50.0)


def test_numeric_summary_with_null_column(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (4.0, None), (10.0, None)],
                               "a double, b double")
    rows = {r.column: r for r in PR.numeric_summary(df, ["a", "b"]).collect()}
    a = rows["a"]
    assert (a["count"], a["min"], a["max"], a.p25, a.p50, a.p75) == (4, 1.0, 10.0, 1.75, 3.0, 5.5)
    assert rows["b"]["count"] == 0 and rows["b"].p50 is None
