"""A third of all order lines on one item: counted lines, spread joins, and what the plans show."""

import re

import pytest
from pyspark.sql import functions as F

from tillcast.operators import daily as D
from tillcast.operators import prepare as P
from tillcast.operators import profile as PR
from tillcast.plans.registry import load_all
from tillcast.sources import fixtures as FX

from conftest import SF_SMALL


@pytest.fixture
def no_broadcast(spark):
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["daily_sales", "value_counts", "totals_per_item", "distinct_items", "txn_enriched",
                                  "promo_running_max", "promotion_summary", "price_variations"])
def test_lines_are_counted_before_the_item_join(spark, no_broadcast, name):
    plan = plan_of(load_all()[name].build(spark, SF_SMALL))
    for scan in [m.start() for m in re.finditer("FileScan parquet .*l_partkey", plan)]:
        above = plan[:scan]
        last_join = max(above.rfind("SortMergeJoin"), above.rfind("ShuffledHashJoin"))
        path = above[last_join:]
        # the join's exchange, the final count, the exchange of kinds, the partial count
        steps = re.findall(r"Exchange hashpartitioning\(l_partkey#\d+L, (\w+)|HashAggregate\(keys=\[(l_partkey)", path)
        assert [a or b for a, b in steps][-3:] == ["l_partkey", "l_shipdate", "l_partkey"], path


@pytest.fixture
def hot(spark):
    """2,000 lines, a third of them on item 1, of few kinds; and the same as counted kinds."""
    lines = spark.range(2000).select(
        F.expr("timestamp_ntz'2018-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(id % 40 as decimal(8,6)))").alias("time"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50 + 2).cast("long").alias("itemID"),
        (F.col("id") % 4 + 1).cast("int").alias("order"),
        F.when(F.col("id") % 97 == 0, None).otherwise((F.col("id") % 5) * 1.25).cast("double").alias("salesPrice"))
    cal = FX.Calendar("2018-01-01", "2018-06-08", "2018-06-29", "2018-06-30")
    return P.add_split(lines, cal), P.add_split(P.line_kinds(lines), cal)


def rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r)
                   for r in df.select(*sorted(df.columns)).collect()), key=str)


@pytest.mark.parametrize("of", [
    P.enrich_transactions, P.running_max_promotion, P.price_levels, P.median_discount, P.price_variations, P.mean_median_gap,
    D.day_totals, D.daily_sales, D.eda_daily, D.price_level_days, D.promotion_summary, PR.totals_per_day, PR.value_counts,
    PR.distinct_items, PR.zero_price_share, PR.lost_revenue_share, PR.histogram_per_item,
    lambda df: PR.totals_per_item(P.price_levels(df, ["itemID"])),
    lambda df: PR.numeric_summary(df, ["itemID", "order", "salesPrice"])],
    ids=lambda f: getattr(f, "__name__", "f"))
def test_counted_lines_give_what_single_lines_give(hot, of):
    single, kinds = hot
    a, b = of(single), of(kinds)
    if "lines" in b.columns and "lines" not in a.columns:
        b = P.single_lines(b)
    assert rows(a) == rows(b)


def test_single_lines_come_back(hot):
    single, kinds = hot
    assert rows(P.single_lines(kinds)) == rows(single) and kinds.count() < single.count() / 2


def test_a_hot_item_is_spread_over_places(spark, hot, no_broadcast):
    joined = P.enrich_transactions(hot[0])
    plan = plan_of(joined)
    assert re.search(r"Exchange hashpartitioning\(split#\d+, itemID#\d+L, _place#\d+L", plan)
    place = hot[0].where("itemID = 1").select(F.pmod(F.xxhash64(*hot[0].columns), F.lit(P.SPREAD)).alias("p"))
    assert place.distinct().count() >= P.SPREAD // 2
    again = plan_of(joined.groupBy("split", "itemID").agg(F.sum("order")))
    assert "partial_sum" in again[:again.index("SortMergeJoin")]


@pytest.mark.parametrize("partitions,reuse", [(1, "true"), (8, "false"), (200, "false")])
def test_global_orders_hold_for_any_partitioning(spark, partitions, reuse):
    rows = spark.range(3000).select(
        F.col("id").alias("itemID"),
        F.when(F.col("id") % 3 == 0, 7.0).when(F.col("id") % 3 == 1, (F.col("id") % 11).cast("double"))
        .otherwise(F.when(F.col("id") % 2 == 0, F.col("id") * 1.25)).alias("v"),
        F.lit(1).alias("one")).repartition(partitions)
    keys = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.exchange.reuse": reuse}
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        for descending in (False, True):
            got = [(r.itemID, r.position, r.running_sum) for r in
                   PR.global_order(rows, "v", descending=descending, sum_col="one").collect()]
            known = sorted(rows.collect(), key=lambda r: (
                r.v is not None, -r.v if descending and r.v is not None else r.v or 0.0, r.itemID))
            assert sorted(got) == sorted((r.itemID, i, i) for i, r in enumerate(known, 1))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
