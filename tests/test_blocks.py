"""The wide matrix in blocks: any row and column equals the long form's."""

import datetime as dt
import os

import numpy as np
from pyspark.sql import functions as F

from tillcast.operators import blocks as W
from tillcast.operators.grid import date_item_matrix
from tillcast.sources.fixtures import Calendar

CAL = Calendar("2024-01-01", "2024-02-10", "2024-03-20", "2024-03-21")


def _txn(spark, n_items=23, n=600):
    rng = np.random.default_rng(8)
    days = [dt.date(2023, 12, 30) + dt.timedelta(days=int(d)) for d in rng.integers(0, 85, n)]
    # a third of the lines on one item; ids far apart
    ids = np.where(rng.random(n) < 0.33, 5, rng.integers(0, n_items, n)) * 1_000_003
    rows = [(int(i), d, int(o), float(p)) for i, d, o, p in zip(ids, days, rng.integers(0, 5, n), np.round(rng.lognormal(2, 1, n), 2))]
    rows += [(999_999_999_999, dt.date(2023, 1, 1), 3, 1.0), (None, dt.date(2024, 1, 5), 1, 1.0)]
    return spark.createDataFrame(rows, "itemID long, date date, `order` long, salesPrice double")


def _rows(df):
    return sorted((r["itemID"], str(r["date"]), r["total_orders"], r["total_values"]) for r in df.collect())


def test_rows_and_columns_equal_the_long_form(spark, tmp_dir):
    txn = _txn(spark)
    path = os.path.join(tmp_dir, "m")
    W.write_blocks(txn, CAL, path, items=4, days=7)
    long = date_item_matrix(txn.where("itemID is not null"), CAL).cache()
    ids = [r[0] for r in long.select("itemID").distinct().collect()]
    for item in [min(ids), 5 * 1_000_003, 999_999_999_999]:
        got = _rows(W.matrix_column(spark, path, item, CAL, days=7))
        assert got == _rows(long.where(F.col("itemID") == item)) and len(got) == 80
    for day in ("2024-01-01", "2024-01-08", "2024-03-20"):
        got = _rows(W.matrix_row(spark, path, day, CAL, days=7))
        assert got == _rows(long.where(F.col("date") == day)) and len(got) == len(ids)
    assert W.matrix_column(spark, path, 77, CAL, days=7).count() == 0


def test_blocks_are_bounded_and_pruned(spark, tmp_dir):
    path = os.path.join(tmp_dir, "m")
    W.write_blocks(_txn(spark), CAL, path, items=4, days=7)
    blocks = spark.read.parquet(f"{path}/blocks")
    assert blocks.agg(F.max(F.size("cells"))).first()[0] <= 4 * 7
    assert blocks.groupBy("date_block", "item_block").count().where("count > 1").count() == 0
    plan = W.matrix_row(spark, path, "2024-01-08", CAL, days=7)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date_block" in plan and "Cartesian" not in plan
    column = W.matrix_column(spark, path, 5 * 1_000_003, CAL, days=7)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(item_block" in column


def test_empty_matrix(spark, tmp_dir):
    path = os.path.join(tmp_dir, "m")
    W.write_blocks(_txn(spark).where("false"), CAL, path)
    assert W.matrix_row(spark, path, "2024-01-08", CAL).count() == 0
    assert W.matrix_column(spark, path, 5, CAL).count() == 0
