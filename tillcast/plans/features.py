"""Order lines -> daily demand -> dense grid -> feature table (train and test).

Shuffles of the whole plan, at full scale:

1. order lines -> (split, item, day), with map-side partial aggregation;
2. daily rows -> (split, item): item windows, grid expansion and every series
   window run inside this one partitioning;
3. the per-item dimension joins (items, median discount) are at item grain,
   before the grid is expanded; Spark broadcasts them only when their measured
   size is under the threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.operators import daily as D
from tillcast.operators import features as X
from tillcast.operators import grid as G
from tillcast.operators import prepare as P
from tillcast.schemas import FEATURE_COLUMNS, ITEM_COLUMNS, LAGS, N_HARMONICS, ROLLING_DAYS
from tillcast.sources.fixtures import Calendar


def daily_table(txn: DataFrame, cal: Calendar, price_basis: str = "price") -> DataFrame:
    """A1 + A2 + A6 + J1: daily sold table of both splits with the median discount."""
    prepared = P.prepared_transactions(txn, cal)
    med = P.median_discount(prepared.where(F.col("split") == "train"))
    return D.daily_sales(prepared, med, price_basis)


def grid_table(txn: DataFrame, cal: Calendar, price_basis: str = "price") -> DataFrame:
    """The dense grid of both splits, gaps filled."""
    return G.dense_grid(daily_table(txn, cal, price_basis), cal)


def feature_table(txn: DataFrame, items: DataFrame, cal: Calendar, price_basis: str = "price",
                  drop_incomplete: bool = True, exclude_current_cumsum: bool = False
                  ) -> DataFrame:
    """The feature table, columns in the order of :data:`FEATURE_COLUMNS` plus ``split``.

    ``drop_incomplete=False`` keeps the first days of each series (NULL lags),
    as needed for the retention count (Q7).
    """
    g = G.dense_grid(daily_table(txn, cal, price_basis), cal, items, ITEM_COLUMNS)
    first = G.split_first_day(cal)
    pos = F.datediff(F.col("date"), first).cast("double")
    length = (F.datediff(G.split_last_day(cal), first) + 1).cast("double")
    mean, std, med = X.rolling_previous("qty_sold", ROLLING_DAYS)
    # Series columns in two projections: first everything ordered by date
    # (one Window operator), then the per-item sums of the harmonics (a second
    # Window operator on the same partition). In this order the date sort of
    # the first also satisfies the second, so the grid is sorted once.
    g = g.select(
        "*", *X.date_field_columns(),
        X.cumulative_sum("qty_sold", exclude_current=exclude_current_cumsum)
        .alias("cum_sum_order"),
        mean.alias("rolling_qty_sold_mean"), std.alias("rolling_qty_sold_std"),
        med.alias("rolling_qty_sold_median"),
        *X.lag_columns("qty_sold", LAGS),
        *X.lag_columns("PricePerEachToday", LAGS, prefix="PricePerEach"),
        *X.lag_columns("sales_value", LAGS))
    g = g.select("*", *[X.harmonic("qty_sold", i + 1, pos, length).alias(f"harmonic_{i}")
                        for i in range(N_HARMONICS)])
    if drop_incomplete:
        g = X.drop_incomplete(g)
    g = X.add_noise(g)
    return g.select(*FEATURE_COLUMNS, "split")


def feature_rows(txn: DataFrame, items: DataFrame, cal: Calendar, price_basis: str = "price",
                 drop_incomplete: bool = True, exclude_current_cumsum: bool = False) -> DataFrame:
    """The rows of :func:`feature_table` with every series column taken from the sold days: windows run over these
    only, and a task writes the grid's rows one by one, without sorting or holding them."""
    first, last = G.split_first_day(cal), G.split_last_day(cal)
    length = (F.datediff(last, first) + 1).cast("double")
    items = X.numbered_copies(items.select("itemID", *ITEM_COLUMNS))
    g = G.dense_grid(daily_table(txn, cal, price_basis), cal, items, [*ITEM_COLUMNS, "_copy", "_copies"],
                     before=lambda sold: X.sold_day_series(sold, first, last, length))
    g = X.grid_series_columns(g, first, length, exclude_current=exclude_current_cumsum)
    if drop_incomplete:
        g = X.drop_incomplete(g)
    return X.add_noise(g.select("*", *X.date_field_columns())).select(*FEATURE_COLUMNS, "split")
