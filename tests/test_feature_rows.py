"""The feature table from its sold days: the same rows as from windows over the grid, without sorting or holding the grid."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tillcast.operators import features as X
from tillcast.operators import grid as G
from tillcast.plans import features as E1
from tillcast.sources import files as IO
from tillcast.sources import fixtures as FX

CAL = FX.Calendar("2018-01-01", "2018-01-24", "2018-02-08", "2018-02-09")


def _txn(spark):
    """Item 1 is sold nearly daily (two prices a day at times), 2 twice, 3 on the last days only, 4 before, in and after the
    calendar; 5 gives units back; some lines have no units, no item or no time."""
    first, rows = dt.datetime(2018, 1, 1, 10), []
    for k in range(39):
        if k % 11 != 4:
            rows += [(first + dt.timedelta(days=k), 1, (k * 7) % 5 + 1, 10.0 + k % 3), (first + dt.timedelta(days=k), 1, 1, 12.5)]
        if k % 3 == 0:
            rows.append((first + dt.timedelta(days=k), 5, (k * 5) % 7 - 3, 4.0))
    rows += [(first + dt.timedelta(days=k), item, n, p) for k, item, n, p in (
        (3, 2, 4, 5.5), (9, 2, 2, 5.0), (23, 3, 9, 1.25), (38, 3, 1, 1.25), (-9, 4, 3, 2.0), (2, 4, 8, 2.0), (60, 4, 5, 2.0),
        (5, None, 2, 3.0), (7, 2, None, 5.0))] + [(None, 2, 3, 5.0)]
    return spark.createDataFrame(rows, "time timestamp_ntz, itemID long, `order` int, salesPrice double")


def _items(spark):
    return spark.createDataFrame([(k, k, k % 2, float(k), "a", k, "b", 10.0) for k in (1, 2, 3, 4)],
                                 "itemID long, brand int, manufacturer int, customerRating double, category1 string, "
                                 "category2 int, category3 string, recommendedRetailPrice double")


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("more", [{}, {"drop_incomplete": False}, {"drop_incomplete": False, "exclude_current_cumsum": True},
                                  {"price_basis": "revenue"}])
def test_rows_are_those_of_windows_over_the_grid(spark, more):
    want, got = (f(_txn(spark), _items(spark), CAL, **more) for f in (E1.feature_table, E1.feature_rows))
    assert got.columns == want.columns
    assert len(_rows(want)) > 50 and _rows(got) == _rows(want)


@pytest.mark.parametrize("more", [{}, {"drop_incomplete": False, "exclude_current_cumsum": True}])
def test_copies_of_an_item_have_their_own_rows(spark, more):
    items = _items(spark)
    items = items.unionByName(items.where("itemID = 1")).unionByName(items.where("itemID <= 2"))  # 3 copies of 1, 2 of 2
    want, got = (f(_txn(spark), items, CAL, **more) for f in (E1.feature_table, E1.feature_rows))

    def rounded(df):  # sums of copies may differ in their last bits
        return sorted((tuple(round(x, 6) + 0.0 if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)
    assert rounded(got) == rounded(want)


def test_sales_outside_the_calendar_and_without_a_day_count_nowhere(spark):
    sold = spark.createDataFrame(
        [("train", 1, d, 5, 10.0, 1.0) for d in ("2017-12-30", None, "2018-01-02", "2018-01-05", "2018-03-01")],
        "split string, itemID long, d string, qty_sold long, sales_value double, PricePerEachToday double").select(
        "split", "itemID", F.to_date("d").alias("date"), "qty_sold", "sales_value", "PricePerEachToday",
        F.lit(1.5).alias("_ppe_fill"))
    first, last = G.split_first_day(CAL), G.split_last_day(CAL)
    length = (F.datediff(last, first) + 1).cast("double")
    rows = X.sold_day_series(sold, first, last, length)
    assert set(X.SERIES_COLUMNS) <= set(rows.columns)
    at = {str(r["date"]): r for r in rows.collect()}
    assert at["2018-01-05"]["_q"] == [0, 0, 0, 0, 5, 0, 0, 5] + [0] * 7 and at["2018-01-05"]["_sum"] == 10
    assert at["2018-01-02"]["_q"] == [0] * 7 + [5] + [0] * 7 and at["2018-01-02"]["_sum"] == 5
    for outside in ("2017-12-30", "None", "2018-03-01"):
        assert at[outside]["_q"] == [0] * 15 and set(at[outside]["_v"]) == {None}


def test_the_grid_is_neither_sorted_nor_held(spark):
    plan = E1.feature_rows(_txn(spark), _items(spark), CAL)._jdf.queryExecution().executedPlan().toString()
    above_grid = plan[:plan.index("Generate")]
    for step in ("Sort", "Window", "Exchange"):
        assert step not in above_grid


def test_the_round_trip_takes_these_rows(spark, monkeypatch, tmp_dir):
    from tillcast.plans.queries import io as Q
    written = []
    monkeypatch.setattr(IO, "write_table", lambda df, path: written.append(df) or df.limit(0).write.mode("overwrite").parquet(path))
    monkeypatch.setattr(Q, "_shared_dir", lambda spark, name: os.path.join(tmp_dir, name))
    monkeypatch.setattr(Q, "_li", lambda spark, sf: _txn(spark))
    monkeypatch.setattr(FX, "items", lambda spark, sf: _items(spark))
    monkeypatch.setattr(Q, "LC", CAL)
    Q.q_feature_table_roundtrip(spark, "")
    plan = written[0]._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan[:plan.index("Generate")] and "Window" not in plan[:plan.index("Generate")]


def test_folders_are_written_without_a_sort_and_the_setting_is_put_back(spark, tmp_dir):
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before, path = spark.conf.get(key), os.path.join(tmp_dir, "t")
    rows = spark.range(0, 100, 1, 1).select("id", (F.col("id") % 2).alias("a"), (F.col("id") % 9).alias("b"))
    for by in ("a", "b"):  # fewer and more folders than files held open
        IO.write_table(rows, path, partition_by=(by,))
        back = spark.read.parquet(path)
        assert sorted((r["id"], r["a"], r["b"]) for r in back.collect()) == [(k, k % 2, k % 9) for k in range(100)]
    assert spark.conf.get(key) == before
    IO.write_table(rows, path, partition_by=("a",))
    files = [f for f in os.listdir(os.path.join(path, "a=1")) if f.endswith(".parquet")]
    assert len(files) == 1
