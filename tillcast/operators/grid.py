"""Calendar (T1) and the gap-free date x item table (T2) with its fills.

Every sold day writes itself and the gap behind it with ``explode(sequence(0, days))``: no cross
join, and the work is spread over the items' partitions. Its size is
items x days, which is the result itself; the calendar length is a parameter,
never derived from the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillcast.functions import MEAN_OF_MONEY, exact_sum, is_nonzero, line_weight, round2, safe_div
from tillcast.sources.fixtures import Calendar

ITEM = ["split", "itemID"]


def _d(s: str) -> Column:
    return F.lit(s).cast("date")


def split_first_day(cal: Calendar) -> Column:
    return F.when(F.col("split") == "train", _d(cal.train_start)).otherwise(_d(cal.test_start))


def split_last_day(cal: Calendar) -> Column:
    return F.when(F.col("split") == "train", _d(cal.split_date)).otherwise(_d(cal.test_end))


#: Tasks of work on whole series for each shuffle partition of the session.
SERIES_TASKS = 4


def item_partitions(df: DataFrame) -> int:
    """Partition count for item-grain work that writes many rows for each it reads: a multiple of the session's
    shuffle parallelism, so that a task's series are a small part of what the shuffle's own tasks were sized for."""
    return SERIES_TASKS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def calendar(spark: SparkSession, cal: Calendar) -> DataFrame:
    """One row per (split, date) of the train and test ranges."""
    spans = spark.createDataFrame([("train", cal.train_start, cal.split_date),
                                   ("test", cal.test_start, cal.test_end)],
                                  "split string, first string, last string")
    return spans.select("split", F.explode(F.sequence(F.col("first").cast("date"),
                                                      F.col("last").cast("date")))
                        .alias("date"))


def every_day(sold: str, first: Column, last: Column) -> Column:
    """All days first..last as (date, m), from a sorted array of sold days (date, m): ``m`` is NULL
    on a gap. Each sold day writes itself and the gap behind it, so the work is linear in the
    number of days; a day before the first one writes the leading gap."""
    inside = F.filter(F.col(sold), lambda e: e["date"].between(first, last))
    nothing = F.get(inside, F.lit(-1))["m"]  # NULL of the right type
    starts = F.concat(F.array(F.struct(F.date_sub(first, 1).alias("date"), nothing.alias("m"))), inside)
    ends = F.concat(F.transform(inside, lambda e: F.date_sub(e["date"], 1)), F.array(last))
    runs = F.zip_with(starts, ends, lambda e, stop: F.transform(
        F.sequence(e["date"], stop), lambda d: F.struct(d.alias("date"), F.when(d == e["date"], e["m"]).alias("m"))))
    return F.filter(F.flatten(runs), lambda x: x["date"] >= first)


def days_and_gaps(sold: DataFrame, keys, first: Column, last: Column, kept, filled, join=None) -> DataFrame:
    """All days first..last of every key as rows, from one row per key and sold day: ``kept`` columns are those of the
    row, ``filled`` ones are NULL on a gap. As :func:`every_day`, but each sold day is a row that writes itself and
    the gap behind it (the first one the gap before it, too), so generated code writes the days one by one and no
    array holds a series. ``join`` may add columns before the gaps are written."""
    w = Window.partitionBy(*keys).orderBy("date")
    stop = F.least(F.coalesce(F.date_sub(F.lead("date").over(w), 1), last), last)
    start = F.when(F.row_number().over(w) == 1, first).otherwise(F.greatest("date", first))
    sold = sold.withColumns({"_start": start, "_gap": stop}).withColumn("_gap", F.datediff("_gap", "_start"))
    if join is not None:
        sold = join(sold)
    days = sold.where(F.col("_gap") >= 0).withColumn("_day", F.explode(F.sequence(F.lit(0), F.col("_gap"))))
    date = F.date_add("_start", F.col("_day"))
    here = date == F.col("date")
    return days.select(*keys, *kept, *[F.when(here, F.col(c)).alias(c) for c in filled], date.alias("date"))


def dense_grid(daily: DataFrame, cal: Calendar, items: DataFrame | None = None,
               item_columns=(), before=None) -> DataFrame:
    """T2 + W14 + W15: every day of the split for every item sold in it.

    Gaps get 0 units, value and promotion; maximum / minimum price, ``Price``
    and ``medianDiscPerc`` take the item's maximum; ``PricePerEachToday`` and
    ``PriceToday`` take the item's mean over sale days, and both columns are
    rounded to 2 afterwards.

    Plan: windows over the daily rows of a (split, item) give the fill values and the
    next sold day; then every row writes its day and the gap behind it
    (:func:`days_and_gaps`). The grid, the largest table of the pipeline, is never
    shuffled, and it leaves this step partitioned by item, which is what the
    series windows downstream need. Item attributes (``items``, ``item_columns``)
    are joined to the daily rows before the expansion, so that join never
    touches the grid either. Columns that ``before`` adds to the daily rows are kept
    on every day that a row writes.
    """
    w = Window.partitionBy(*ITEM)

    def fill(c: str) -> Column:
        x = F.when(is_nonzero("qty_sold"), F.col(c))
        return safe_div(F.sum(x.cast(MEAN_OF_MONEY)).over(w).cast("double"), F.count(x).over(w))

    extra = list(item_columns)
    top = ["maxItemPrice", "minItemPrice", "Price", "medianDiscPerc"]
    sold = daily.withColumns({**{c: F.max(c).over(w) for c in top},
                              "_ppe_fill": fill("PricePerEachToday"), "_today_fill": fill("PriceToday")})
    known = sold.columns
    sold = before(sold) if before is not None else sold
    added = [c for c in sold.columns if c not in known]
    joined = (lambda rows: rows.join(items.select("itemID", *extra), "itemID", "left")) if items is not None and extra else None
    g = days_and_gaps(sold, ITEM, split_first_day(cal), split_last_day(cal), [*top, "_ppe_fill", "_today_fill", *added, *extra],
                      ["qty_sold", "sales_value", "promotion", "PricePerEachToday", "PriceToday"], joined)
    return g.select(
        "split", "date", "itemID",
        F.coalesce("qty_sold", F.lit(0).cast("long")).alias("qty_sold"),
        F.coalesce("sales_value", F.lit(0.0)).alias("sales_value"),
        F.coalesce("promotion", F.lit(0)).alias("promotion"),
        "maxItemPrice", "minItemPrice",
        round2(F.coalesce("PricePerEachToday", "_ppe_fill")).alias("PricePerEachToday"),
        "Price",
        round2(F.coalesce("PriceToday", "_today_fill")).alias("PriceToday"),
        "medianDiscPerc", *added, *extra)


def sold_days(txn: DataFrame) -> DataFrame:
    """Units and value per (item, date) with an order."""
    n = line_weight(txn)
    return txn.groupBy("itemID", "date").agg(
        F.sum(F.col("order") * n).cast("long").alias("total_orders"),
        F.coalesce(exact_sum(F.col("order") * F.col("salesPrice") * n), F.lit(0.0))
        .alias("total_values"))


def date_item_matrix(txn: DataFrame, cal: Calendar, mean_days: int | None = None) -> DataFrame:
    """A17 (long form): units and value per (date, item) over every day of the
    calendar for every item sold, gaps 0. Built like :func:`dense_grid`: every sold day
    writes itself and the gap behind it. Wide pivots are left
    to the caller for a short, given list of items (:func:`wide_matrix`).

    With ``mean_days`` there is a column ``rolling_mean``, too: the mean value of so many days up to the row's, NULL on the
    first days. It changes only where a sold day enters or leaves the window, so it is taken there, and all days up
    to the next such day write it; no window runs over the matrix."""
    first, last = _d(cal.train_start), _d(cal.test_end)
    day = sold_days(txn).repartition(item_partitions(txn), "itemID")
    kept = []
    if mean_days is not None:
        leaves = F.struct(F.date_add("date", mean_days).alias("date"), *[F.lit(None).cast(t).alias(c) for c, t in day.dtypes[2:]])
        both = F.array(F.struct(*day.columns[1:]), leaves)
        day = (day.select("itemID", F.inline(both)).groupBy("itemID", "date")
               .agg(F.max("total_orders").alias("total_orders"), F.max("total_values").alias("total_values"))
               .withColumn("_value", F.when(F.col("date").between(first, last), F.col("total_values")))
               .withColumn("_mean", F.coalesce(F.expr(f"sum(_value) OVER (PARTITION BY itemID ORDER BY date RANGE BETWEEN {mean_days - 1} PRECEDING"
                                                      " AND CURRENT ROW)"), F.lit(0.0)) / mean_days)
               .withColumn("_at", F.col("date")))  # the gap before an item's first row has 0
        kept = ["_mean", "_at"]
    g = days_and_gaps(day, ["itemID"], first, last, kept, ["total_orders", "total_values"])
    mean = [F.when(F.col("date") >= F.date_add(first, mean_days - 1), F.when(F.col("date") >= F.col("_at"), F.col("_mean")).otherwise(0.0)).alias("rolling_mean")] if kept else []
    return g.select("itemID", "date",
                    F.coalesce("total_orders", F.lit(0).cast("long")).alias("total_orders"),
                    F.coalesce("total_values", F.lit(0.0)).alias("total_values"), *mean)


def wide_matrix(matrix: DataFrame, item_ids, value: str = "total_orders") -> DataFrame:
    """A17 (wide form): one row per date, one column per item of the given list
    (an explicit pivot value list, so the width is fixed by the caller)."""
    ids = list(item_ids)
    return (matrix.where(F.col("itemID").isin(ids)).groupBy("date")
            .pivot("itemID", ids).agg(F.sum(value)).fillna(0))


def wide_by_rank(matrix: DataFrame, top: DataFrame, k: int, value: str = "total_orders") -> DataFrame:
    """Wide report of the items of ``top`` (itemID, count; at most k rows): one row per date,
    columns item_1 .. item_k by falling count (tie: itemID)."""
    rank = F.row_number().over(Window.orderBy(F.desc("count"), "itemID"))  # k rows
    of = matrix.join(F.broadcast(top.select("itemID", rank.alias("_r"))), "itemID")
    return of.groupBy("date").agg(*[
        F.sum(F.when(F.col("_r") == r, F.col(value)).otherwise(0)).cast("long").alias(f"item_{r}")
        for r in range(1, k + 1)])
