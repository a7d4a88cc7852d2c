"""Steps whose cost must not outgrow the input: facts that are never broadcast, running maxima over kinds of lines, day counts."""

from pyspark.sql import functions as F

from tillcast.operators import daily as D
from tillcast.operators import prepare as P
from tillcast.sources import fixtures as FX


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _lines(spark, n=300):
    """Lines of 5 items at 7 times, each kind several times; some without a time, an item or a price."""
    rows = spark.range(n).select(
        F.when(F.col("id") % 29 != 0, F.expr("timestamp_ntz'2018-06-07 10:00:00' + make_dt_interval(id % 3, 0, id % 7, 0)")).alias("time"),
        F.when(F.col("id") % 31 != 0, F.col("id") % 5).alias("itemID"),
        F.lit(1).alias("order"),
        F.when(F.col("id") % 37 != 0, ((F.col("id") * 13) % 11).cast("double")).alias("salesPrice"))
    return P.add_split(rows, FX.Calendar("2018-01-01", "2018-06-08", "2018-06-29", "2018-06-30"))


def test_the_copies_of_facts_are_not_broadcast(spark):
    items = spark.createDataFrame([(k, 5.0) for k in range(5)], "itemID long, recommendedRetailPrice double")
    for joined in (P.promotion_vs_retail_price(_lines(spark), items), P.enrich_transactions(_lines(spark)),
                   D.price_level_days(_lines(spark))):
        plan = plan_of(joined)
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_running_maximum_joins_slices_once_and_copies_no_facts(spark):
    plan = plan_of(P.running_max_promotion(_lines(spark)))
    assert "_place" not in plan and "BroadcastExchange" not in plan and plan.count("SortMergeJoin") == 1


def test_running_maximum_equals_a_walk_over_the_lines(spark):
    lines = _lines(spark).where("time IS NOT NULL")
    rows = lines.collect()
    want = []
    for r in rows:
        top = None
        if r["itemID"] is not None:
            seen = [o["salesPrice"] for o in rows if o["itemID"] == r["itemID"] and o["split"] == r["split"]
                    and o["time"] <= r["time"] and o["salesPrice"] is not None]
            top = max(seen, default=None)
        flag = int(top is not None and r["salesPrice"] is not None and r["salesPrice"] < top)
        want.append((str(r["itemID"]), str(r["time"]), str(r["salesPrice"]), str(top), flag))
    got = [(str(r["itemID"]), str(r["time"]), str(r["salesPrice"]), str(r["runningMaxPrice"]), r["in_promotion_hist"])
           for r in P.running_max_promotion(lines).collect()]
    assert sorted(got) == sorted(want)


def test_promotion_days_are_counted_without_expanding_the_rows(spark):
    summary = D.promotion_summary(_lines(spark).where("itemID IS NOT NULL"))
    assert "Expand" not in plan_of(summary)
    days = {(r["split"], r["itemID"]): (r["count_days_no_promo"], r["count_days_promo"]) for r in summary.collect()}
    flags = D.units_by_promotion_day(_lines(spark).where("itemID IS NOT NULL")).collect()
    for key, found in days.items():
        assert found == tuple(len({r["date"] for r in flags if (r["split"], r["itemID"]) == key and r["promotion"] == p and r["date"]})
                              for p in (0, 1))


def test_matrix_writes_gaps_as_rows_and_clips_at_the_calendar(spark):
    import datetime as dt
    from tillcast.operators import grid as G
    cal = FX.Calendar("2018-01-03", "2018-01-05", "2018-01-07", "2018-01-08")
    sold = [(1, "2018-01-04", 2), (1, "2018-01-06", 3), (2, "2018-01-01", 5), (2, "2018-01-07", 1), (3, "2018-02-01", 4),
            (4, None, 7), (4, "2018-01-05", 6), (None, "2018-01-03", 8), (5, "2017-01-01", 1)]
    lines = spark.createDataFrame(sold, "itemID long, d string, order int").select(
        "itemID", F.to_date("d").alias("date"), "order", F.lit(1.0).alias("salesPrice"))
    matrix = G.date_item_matrix(lines, cal)
    assert "inline" not in plan_of(matrix) and "collect_list" not in plan_of(matrix)
    days = [dt.date(2018, 1, k) for k in range(3, 8)]
    units = {(i, d): n for i, d, n in sold}
    want = {(i, d): units.get((i, d.isoformat()), 0) for i in {i for i, _, _ in sold} for d in days}
    got = matrix.collect()
    assert len(got) == len(want) and {(r["itemID"], r["date"]): r["total_orders"] for r in got} == want
    assert all(r["total_values"] == r["total_orders"] for r in got)


def test_series_are_dealt_to_more_tasks_than_the_shuffle(spark):
    from tillcast.operators import grid as G
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert G.date_item_matrix(_lines(spark), FX.LINEITEM_DAYS).rdd.getNumPartitions() == G.SERIES_TASKS * n > n


def test_gradients_beyond_the_doubles_are_added_exactly():
    import numpy as np
    import pyarrow as pa
    from tillcast.operators import boosting as T
    rng = np.random.default_rng(3)
    y = rng.integers(-2 ** 40, 2 ** 40, 500).astype(float) * 2 ** 12
    x = [None if k % 7 == 0 else float(k % 5) for k in range(500)]
    rows = pa.RecordBatch.from_arrays([pa.array(y), pa.array(x, pa.float64())], names=["_y", "x"])
    packed = list(T._packed([[0.0, 1.0, 2.0]], 0.0, "<i2")([rows.slice(0, 200), rows.slice(200)]))
    read, end = T._reader(1, "<i2", 2, [])
    tree = T.Tree({1: (0, 1, True, 0.0)}, {}, {}).arrays(2, 0.1)
    found = pa.Table.from_batches(T._cells(read, end, 1, 3, 1, tree, 1.0)(packed)).to_pylist()
    want = {}
    for v, t in zip(x, y):
        b = None if v is None else min(3, int(v))
        at = (2 if b is None or b <= 1 else 3, b)
        g, h = want.get(at, (0, 0))
        want[at] = (g - int(t), h + 1)
    assert {(r["node"], r["bin"]): (r["g"], r["h"]) for r in found} == want


def test_rolling_means_of_a_matrix_need_no_window_over_it(spark):
    from tillcast.operators import grid as G
    from tillcast.operators import profile as PR
    cal = FX.Calendar("2018-01-03", "2018-01-20", "2018-02-07", "2018-02-08")
    sold = [(1, "2018-01-04", 2.1), (1, "2018-01-06", 3.7), (1, "2018-01-18", 0.1), (1, "2018-01-20", 5.3), (1, "2018-01-21", 0.7),
            (2, "2018-01-01", 5.0), (2, "2018-01-07", 1.0), (2, "2018-02-07", 1.9), (3, "2018-03-01", 4.0), (4, None, 7.0), (4, "2018-01-05", 6.0),
            (4, "2018-01-05", 0.3), (None, "2018-01-03", 8.0), (5, "2017-01-01", 1.0), (6, "2018-01-02", 4.0), (6, "2018-01-16", 3.0)]
    lines = spark.createDataFrame(sold, "itemID long, d string, salesPrice double").select(
        "itemID", F.to_date("d").alias("date"), F.lit(1).alias("order"), "salesPrice")
    for n in (14, 3, 1):
        plain = G.date_item_matrix(lines, cal)
        matrix = G.date_item_matrix(lines, cal, n)
        assert sorted(map(str, matrix.drop("rolling_mean").collect())) == sorted(map(str, plain.collect()))
        got = PR.rolling_value_mean(matrix, n)
        assert sorted(map(str, got.collect())) == sorted(map(str, PR.rolling_value_mean(plain, n).collect()))
        plan = plan_of(got)
        assert "Window" not in plan[:plan.index("Generate")]


def test_rolling_value_writes_its_rows_without_a_window(spark):
    from conftest import SF_SMALL
    from tillcast.plans.registry import load_all
    plan = plan_of(load_all()["rolling_value_14"].build(spark, SF_SMALL))
    assert "Window" not in plan[:plan.index("Generate explode")]
