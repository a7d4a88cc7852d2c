"""Command line: the three pipe-separated inputs -> feature tables, model
scores and a submission file.

    spark-submit -m tillcast.plans.run --orders o/ --items items.csv \
        --infos infos.csv --out results/

Dates default to the retail calendar of the brief (train 2018-01-01..06-08,
test ..06-29, forecast from 06-30).
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tillcast.operators.prepare import line_kinds
from tillcast.plans import features as E1
from tillcast.plans import modelling as E2
from tillcast.sources import files as IO
from tillcast.sources.fixtures import Calendar

# The calendar of the brief.
DEFAULT_CALENDAR = ("2018-01-01", "2018-06-08", "2018-06-29", "2018-06-30")


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    ap.add_argument("--orders", required=True)
    ap.add_argument("--items", required=True)
    ap.add_argument("--infos", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--calendar", nargs=4, default=DEFAULT_CALENDAR,
                    metavar=("TRAIN_START", "SPLIT_DATE", "TEST_END", "FORECAST_START"))
    ap.add_argument("--price-basis", choices=("price", "revenue"), default="price",
                    help="what Price and PriceToday are: mean line price, or revenue of the day")
    ap.add_argument("--no-models", action="store_true")
    a = ap.parse_args(argv)

    spark = SparkSession.builder.appName("tillcast").getOrCreate()
    cal = Calendar(*a.calendar)
    orders = line_kinds(IO.read_orders(spark, a.orders))
    items = IO.read_items(spark, a.items)
    out = a.out.rstrip("/")
    IO.write_table(E1.feature_table(orders, items, cal, a.price_basis), f"{out}/features")
    if a.no_models:
        return
    features = IO.read_feature_table(spark, f"{out}/features",
                                     schema=IO.feature_schema(items.schema))
    report = E2.model_report(features)
    for name in ("gbt_scores", "rf_scores", "importance"):
        IO.write_table(report[name], f"{out}/{name}", partition_by=())
    infos = IO.read_infos(spark, a.infos)
    IO.write_table(E2.horizon_table(orders, items, infos, cal), f"{out}/horizon", partition_by=())
    horizon = spark.read.schema(E2.horizon_schema(items)).parquet(f"{out}/horizon")
    IO.write_submission(E2.forecast_all_items(horizon, cal), f"{out}/submission")


if __name__ == "__main__":
    main()
