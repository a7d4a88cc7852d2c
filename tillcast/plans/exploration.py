"""The exploration tables (results table, promotion measures, date x item
matrix and its checks, sale-day profile, histograms) from the three inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.operators import daily as D
from tillcast.operators import grid as G
from tillcast.operators import prepare as P
from tillcast.operators import profile as PR
from tillcast.sources.fixtures import Calendar


def exploration_tables(orders: DataFrame, items: DataFrame, infos: DataFrame,
                       cal: Calendar) -> dict[str, DataFrame]:
    """All exploration outputs as lazy DataFrames, keyed by name."""
    dated = P.add_split(orders, cal)
    eda = P.positive_prices(dated)
    results = D.eda_results(eda, items).drop("split")
    levels = P.price_levels(eda, keys=["itemID"])
    matrix = G.date_item_matrix(dated, cal)
    prof = PR.sale_day_profile(matrix)
    per_day = results.groupBy("date").agg(F.sum("order").alias("units"))
    per_item = results.groupBy("itemID").agg(F.sum("order").alias("units"))
    return {
        "numeric_summary": PR.numeric_summary(orders, ["itemID", "order", "salesPrice"]),
        "items_summary": PR.string_summary(items),
        "infos_summary": PR.string_summary(infos),
        "results": results,
        "per_line_by_promotion": D.per_line_by_promotion(levels),
        "per_day_by_promotion": D.per_transaction_by_promotion(
            results, price="weightedAveragePrice"),
        "totals_per_item": PR.totals_per_item(levels),
        "matrix": matrix,
        "reconciliation": PR.reconciliation(dated, matrix),
        "sale_day_profile": prof,
        "profile_correlation": PR.profile_correlation(prof),
        "items_above_k": PR.items_above(prof),
        "concentration_curve": PR.concentration_curve(prof),
        "rolling_value_14": PR.rolling_value_mean(matrix, 14),
        "hist_daily_units": PR.histogram(per_day, "units", 30),
        "hist_item_units": PR.histogram(per_item, "units", 30),
        "hist_price": PR.histogram(results, "weightedAveragePrice", 30),
        "hist_log_units": PR.histogram(PR.log_values(results, "order"), "log_order", 30),
    }
