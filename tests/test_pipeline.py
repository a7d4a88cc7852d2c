"""Invariants, determinism, sources and sinks, and the oracle gate at sf0.001."""

import os

import pytest
from pyspark.sql import functions as F

from tillcast.plans import features as E1
from tillcast.plans.registry import load_all
from tillcast.sources import fixtures as FX
from tillcast.sources import files as IO

from conftest import SF_SMALL

LC = FX.LINEITEM_CALENDAR


def test_grid_is_items_times_days(spark):
    txn = FX.transactions(spark, SF_SMALL)
    grid = E1.grid_table(txn, LC)
    daily = E1.daily_table(txn, LC)
    n_days = {"train": 159, "test": 21}
    items = {r.split: r.n for r in daily.groupBy("split").agg(
        F.count_distinct("itemID").alias("n")).collect()}
    rows = {r.split: r["count"] for r in grid.groupBy("split").count().collect()}
    assert rows == {s: items[s] * n_days[s] for s in items}
    # units are preserved by the fill
    assert grid.agg(F.sum("qty_sold")).first()[0] == daily.agg(F.sum("qty_sold")).first()[0]


def test_feature_table_deterministic_across_partitionings(spark):
    txn = FX.transactions(spark, SF_SMALL)
    items = FX.items(spark, SF_SMALL)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    a = sorted(tuple(r) for r in E1.feature_table(txn, items, LC).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    b = sorted(tuple(r) for r in E1.feature_table(txn, items, LC).collect())
    assert len(a) > 0

    def close(r, s):
        return all(x == y or (isinstance(x, float) and abs(x - y) < 1e-9) for x, y in zip(r, s))
    assert len(a) == len(b) and all(close(r, s) for r, s in zip(a, b))


def test_orders_csv_roundtrip(spark, tmp_dir):
    txn = FX.transactions(spark, SF_SMALL)
    path = os.path.join(tmp_dir, "orders")
    (txn.write.option("sep", "|").option("header", True)
     .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path))
    back = IO.read_orders(spark, path)
    assert back.schema == __import__("tillcast.schemas", fromlist=["ORDERS"]).ORDERS
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, txn.collect()))


def test_feature_table_write_and_read(spark, tmp_dir):
    ft = E1.feature_table(FX.transactions(spark, SF_SMALL), FX.items(spark, SF_SMALL), LC)
    path = os.path.join(tmp_dir, "features")
    IO.write_table(ft, path)
    assert sorted(d for d in os.listdir(path) if d.startswith("split=")) == ["split=test", "split=train"]
    schema = IO.feature_schema(FX.items(spark, SF_SMALL).schema)
    back = IO.read_feature_table(spark, path, schema=schema)
    assert back.count() == ft.count()
    assert back.where("split = 'test'").count() == ft.where("split = 'test'").count()


def test_submission_file(spark, tmp_dir):
    fc = spark.createDataFrame([(1, 3.4), (2, -1.0), (3, 2.5)], "itemID long, demandPrediction double")
    path = os.path.join(tmp_dir, "sub")
    IO.write_submission(fc.coalesce(1), path)
    part = [f for f in os.listdir(path) if f.endswith(".csv")][0]
    lines = open(os.path.join(path, part)).read().split()
    assert lines[0] == "itemID|demandPrediction"
    assert sorted(lines[1:]) == ["1|3", "2|0", "3|2"]


def test_entry_smoke(spark):
    import importlib.util
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(root, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    df = mod.entry(spark)
    assert df.count() > 0
    assert set(mod.oracle_sql()) <= set(mod.queries())


SQL_QUERIES = sorted(n for n, q in load_all().items() if q.sql is not None)


@pytest.fixture(scope="module")
def duck():
    from oracle_check import duck as make
    return make(SF_SMALL)


@pytest.mark.parametrize("name", SQL_QUERIES)
def test_oracle_sf0001(spark, duck, name):
    from oracle_check import compare
    res = compare(spark, duck, load_all()[name], SF_SMALL, verbose=True)
    assert res["status"] == "ok", res


def test_exploration_tables_run(spark):
    from tillcast.plans.exploration import exploration_tables
    tabs = exploration_tables(FX.transactions(spark, SF_SMALL), FX.items(spark, SF_SMALL),
                              FX.infos(spark, SF_SMALL), LC)
    assert tabs["reconciliation"].where("not ok").count() == 0 < tabs["reconciliation"].count()
    assert tabs["results"].count() > 0
    assert sum(r["count"] for r in tabs["hist_price"].collect()) == tabs["results"].count()


def test_run_from_csv_files(spark, tmp_dir):
    from tillcast.plans import run
    txn, items = FX.transactions(spark, SF_SMALL), FX.items(spark, SF_SMALL)
    for name, df in (("orders", txn), ("items", items), ("infos", FX.infos(spark, SF_SMALL))):
        (df.write.option("sep", "|").option("header", True)
         .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(os.path.join(tmp_dir, name)))
    out = os.path.join(tmp_dir, "out")
    run.main(["--orders", os.path.join(tmp_dir, "orders"), "--items", os.path.join(tmp_dir, "items"),
              "--infos", os.path.join(tmp_dir, "infos"), "--out", out, "--no-models",
              "--calendar", LC.train_start, LC.split_date, LC.test_end, LC.forecast_start])
    back = IO.read_feature_table(spark, os.path.join(out, "features"),
                                 schema=IO.feature_schema(IO.read_items(
                                     spark, os.path.join(tmp_dir, "items")).schema))
    assert back.count() == E1.feature_table(txn, items, LC).count()


def test_model_report_on_events(spark):
    from tillcast.plans.modelling import model_report
    ft = E1.feature_table(FX.event_transactions(spark, SF_SMALL), FX.event_items(spark, SF_SMALL),
                          FX.EVENTS_CALENDAR)
    rep = model_report(ft)
    s = rep["gbt_scores"].first()
    assert s.n > 0 and 0.0 <= s.accuracy <= 1.0
    imp = rep["importance"].collect()
    assert len(imp) == 42 and abs(sum(r.importance for r in imp) - 1.0) < 1e-6
    fc = rep["forecast"].collect()
    assert fc and all(r.demandPrediction >= 0 for r in fc)


def test_direct_forecast_on_events(spark):
    from tillcast.operators.model import direct_forecast
    cal = FX.EVENTS_CALENDAR
    txn = FX.event_transactions(spark, SF_SMALL)
    ft = E1.feature_table(txn, FX.event_items(spark, SF_SMALL), cal)
    grid = E1.grid_table(txn, cal)
    fc = direct_forecast(ft, grid, cal.split_date, horizon=5, maxIter=5)
    rows = fc.collect()
    n_items = grid.where("split = 'train'").select("itemID").distinct().count()
    assert len(rows) == n_items and all(r.demandPrediction >= 0 for r in rows)


def test_run_with_models_writes_submission(spark, tmp_dir):
    from tillcast.plans import run
    cal = FX.EVENTS_CALENDAR
    inputs = (("orders", FX.event_transactions(spark, SF_SMALL)),
              ("items", FX.event_items(spark, SF_SMALL)),
              ("infos", FX.event_infos(spark, SF_SMALL)))
    for name, df in inputs:
        (df.write.option("sep", "|").option("header", True)
         .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(os.path.join(tmp_dir, name)))
    out = os.path.join(tmp_dir, "out")
    run.main(["--orders", os.path.join(tmp_dir, "orders"), "--items", os.path.join(tmp_dir, "items"),
              "--infos", os.path.join(tmp_dir, "infos"), "--out", out,
              "--calendar", cal.train_start, cal.split_date, cal.test_end, cal.forecast_start])
    sub = spark.read.option("sep", "|").option("header", True).csv(os.path.join(out, "submission"))
    assert sub.columns == ["itemID", "demandPrediction"]
    assert sub.count() == FX.event_items(spark, SF_SMALL).count() == sub.select("itemID").distinct().count()
    assert sub.where("cast(demandPrediction as int) < 0").count() == 0
    assert os.path.isdir(os.path.join(out, "gbt_scores"))


def test_written_tables_take_less_disk_and_read_back(spark, tmp_dir):
    import glob

    import pyarrow.parquet as pq
    df = spark.range(500).select("id", F.sin("id").alias("x"), F.when(F.col("id") % 3 == 0, "train").otherwise("test").alias("split"))
    path = os.path.join(tmp_dir, "table")
    IO.write_table(df, path)
    codecs = {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in glob.glob(f"{path}/split=*/*.parquet")}
    assert codecs == {"ZSTD"}
    back = IO.read_feature_table(spark, path, schema=df.schema)
    assert sorted(map(str, back.select(df.columns).collect())) == sorted(map(str, df.collect()))
