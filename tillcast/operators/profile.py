"""Profiles and data checks: totals, concentration, histograms, summaries,
uniqueness / referential / reconciliation checks, seeded samples
(A15-A29, W9, W12, W13, O1-O4, Q1-Q8).

All of these are aggregates with partial aggregation, or windows over tables
that are already one row per item or per day.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.functions import (exact_sum, is_nonzero, line_weight, md5_uniform, round2,
                                safe_div)
from tillcast.operators.features import rolling_mean_current
from tillcast.operators.prepare import spread_join


def _value(txn: DataFrame) -> Column:
    return F.col("order") * F.col("salesPrice") * line_weight(txn)


# --- A15, A16, A18, A22, A23, A24, A28, A29 -------------------------------------------

def totals_per_day(txn: DataFrame) -> DataFrame:
    """Units and value per day."""
    return txn.groupBy("date").agg(F.sum(F.col("order") * line_weight(txn)).cast("long").alias("total_orders"),
                                   F.coalesce(exact_sum(_value(txn)), F.lit(0.0))
                                   .alias("total_values"))


def totals_per_item(levels: DataFrame) -> DataFrame:
    """Per item total units, value, and whether it was ever on promotion,
    from price levels (:func:`prepare.price_levels` with keys ``["itemID"]``)."""
    return levels.groupBy("itemID").agg(
        F.sum("units").cast("long").alias("order"),
        exact_sum("value").alias("value"),
        F.bool_or(F.col("promotion") == 1).alias("in_promotion"))


def value_counts(df: DataFrame, col: str = "itemID") -> DataFrame:
    """Rows per value, most frequent first (ties by value)."""
    return df.groupBy(col).agg(F.sum(line_weight(df)).cast("long").alias("count")).orderBy(F.desc("count"), col)


def sale_day_profile(matrix: DataFrame) -> DataFrame:
    """Per item total value, number of days with value != 0, value per sale day.

    The total is a sum of money, rounded to whole cents, so equal totals are
    exact ties whatever order the sum was taken in (rankings break ties by item).
    """
    p = matrix.groupBy("itemID").agg(
        round2(exact_sum("total_values")).alias("total_value"),
        F.count_if(is_nonzero("total_values")).alias("n_sale_days"))
    return p.withColumn("avg_value_sale_day", safe_div(F.col("total_value"),
                                                       F.col("n_sale_days")))


def profile_correlation(profile: DataFrame) -> DataFrame:
    """Pearson correlation matrix of the three A22 columns, long form."""
    cols = ["total_value", "n_sale_days", "avg_value_sale_day"]
    exprs = [F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}")
             for a in cols for b in cols]
    wide = profile.agg(*exprs)
    pairs = F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                               F.col(f"{a}__{b}").alias("corr"))
                      for a in cols for b in cols])
    return wide.select(F.inline(pairs))


# The sale-day thresholds of the item profile.
SALE_DAY_THRESHOLDS = (1, 5, 25, 50, 100)


def items_above(profile: DataFrame, ks=SALE_DAY_THRESHOLDS) -> DataFrame:
    """Number of items sold on more than k days, for each k."""
    return profile.agg(*[F.count_if(F.col("n_sale_days") > k).alias(f"k{k}") for k in ks]) \
        .select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"),
                                            F.col(f"k{k}").alias("n_items")) for k in ks])))


def distinct_items(txn: DataFrame) -> DataFrame:
    """Number of distinct items."""
    return txn.agg(F.count_distinct("itemID").alias("n_items"))


def zero_price_share(txn: DataFrame) -> DataFrame:
    """% of lines with price 0."""
    n, price = line_weight(txn), F.col("salesPrice")
    return txn.agg((safe_div(F.sum(F.when(price == 0, n).when(price.isNotNull(), 0)),
                             F.sum(F.when(price.isNotNull(), n))) * 100).alias("zero_price_pct"))


# --- A19, A20 (J4) ----------------------------------------------------------------------

def lost_items(split_txn: DataFrame) -> DataFrame:
    """Items sold in test but never in train."""
    train = split_txn.where(F.col("split") == "train").select("itemID").distinct()
    return (split_txn.where(F.col("split") == "test").select("itemID").distinct()
            .join(train, "itemID", "left_anti")
            .withColumn("will_be_lost", F.lit("yes")))


def lost_revenue_share(split_txn: DataFrame) -> DataFrame:
    """Revenue share (%) of the J4 items over all lines, round 2; taken before P4.

    Revenue is summed per item first (partial aggregate), so the lost-item flag
    is joined at item grain, not to every line."""
    per_item = split_txn.groupBy("itemID").agg(exact_sum(_value(split_txn)).alias("_rev"))
    flagged = per_item.join(lost_items(split_txn), "itemID", "left")
    lost = F.col("will_be_lost") == "yes"
    return flagged.agg(
        F.count_if(lost).alias("n_lost_items"),
        round2(safe_div(exact_sum(F.when(lost, F.col("_rev"))), exact_sum("_rev")) * 100)
        .alias("lost_revenue_pct"))


def item_coverage(train_txn: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct sold items / all items, %, round 2."""
    sold = train_txn.select("itemID").distinct().select(F.lit(1).cast("long").alias("s"),
                                                        F.lit(0).cast("long").alias("i"))
    every = items.select(F.lit(0).cast("long").alias("s"), F.lit(1).cast("long").alias("i"))
    c = sold.unionByName(every).agg(F.sum("s").alias("n_sold"), F.sum("i").alias("n_items"))
    return c.withColumn("coverage_pct", round2(safe_div(F.col("n_sold"), F.col("n_items"))
                                               * 100))


# --- A25, A26, A27: histograms -------------------------------------------------------------

def _bucket(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin 1..bins of equal width on [lo, hi], last bin closed; one bin if lo = hi."""
    b = F.least(F.floor((x - lo) / (hi - lo) * bins).cast("int") + 1, F.lit(bins))
    return F.when(hi > lo, b).otherwise(F.when(x.isNotNull(), F.lit(1)))


def histogram(df: DataFrame, col: str, bins: int = 10, weight: str | None = None) -> DataFrame:
    """Equal-width histogram from min to max: bin, edges, count, % of non-NULL.

    ``weight`` counts each row that many times (rows of a pre-aggregated table).
    Minimum, maximum and total are one scalar subquery: Spark runs it once and
    hands the values to every task.
    """
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    x = df.select(F.col(col).cast("double").alias("x"), w.alias("_w")).where(
        F.col("x").isNotNull())
    st = x.select(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi"),
                           F.sum("_w").alias("n"))).scalar()
    lo, hi, n = st.getField("lo"), st.getField("hi"), st.getField("n")
    h = x.groupBy(_bucket(F.col("x"), lo, hi, bins).alias("bin")).agg(
        F.sum("_w").alias("count"))
    width = (hi - lo) / bins
    return h.select(
        "bin", (lo + (F.col("bin") - 1) * width).alias("bin_lo"),
        F.when(F.col("bin") == bins, hi).otherwise(lo + F.col("bin") * width).alias("bin_hi"),
        "count", (F.col("count") / n * 100).alias("pct"))


def histogram_per_item(df: DataFrame, col: str = "salesPrice", bins: int = 10,
                       key: str = "itemID") -> DataFrame:
    """Histogram within each item (its own min..max), counts per (item, bin).

    Rows are first counted per (item, value), a partial aggregate; the item's
    min and max are grouped and joined back, so a hot item's rows or values
    never meet in one task.
    """
    lv = (df.select(key, F.col(col).cast("double").alias("x"), line_weight(df).alias("w"))
          .where(F.col("x").isNotNull()).groupBy(key, "x").agg(F.sum("w").cast("long").alias("n")))
    ends = lv.groupBy(key).agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    b = spread_join(lv, ends, [key]).withColumn("bin", _bucket(F.col("x"), F.col("_lo"), F.col("_hi"), bins))
    return b.groupBy(key, "bin").agg(F.sum("n").alias("count"))


def log_values(df: DataFrame, col: str = "order") -> DataFrame:
    """F11 + A27 input: natural log of each value (NULL for values <= 0)."""
    return df.withColumn(f"log_{col}", F.ln(F.col(col)))


# --- W9, W12, W13 --------------------------------------------------------------------------

def rolling_value_mean(matrix: DataFrame, n: int = 14) -> DataFrame:
    """Per item, mean of daily value over the last ``n`` days including the current;
    incomplete windows dropped. A matrix that was written with these means (``mean_days`` of
    :func:`tillcast.operators.grid.date_item_matrix`) has them already."""
    m = matrix if "rolling_mean" in matrix.columns else matrix.withColumn(
        "rolling_mean", rolling_mean_current("total_values", n, keys=["itemID"]))
    return m.where(F.col("rolling_mean").isNotNull()).select("itemID", "date", "rolling_mean")


#: Ranges that a global order, or a column's distinct values, are cut into.
RANGES = 64


def _range_of(x: Column, marks: Column) -> Column:
    return F.size(F.filter(marks, lambda m: m < x))


def global_order(df: DataFrame, by: str, tie: str = "itemID", descending: bool = False,
                 sum_col: str | None = None) -> DataFrame:
    """1-based ``position`` of each row in the order of ``by`` (ties by ascending ``tie``),
    and optionally the running sum of ``sum_col`` along it, without gathering the table
    in one task.

    Rows are dealt to ranges of ``by`` between quantile marks; the marks are a scalar
    subquery, so every use of them sees the same values, and a range is a column of the row,
    not a property of some exchange. A value that is several marks at once (many rows have it) is
    the last of its range; its rows are dealt once more, by ranges of ``tie``. The counts of the
    ranges, at most ``RANGES * (RANGES + 1)`` rows, give each its start; rows are numbered
    within their range.
    """
    steps = [k / RANGES for k in range(1, RANGES)]
    x = F.col(by).cast("double")
    s = df.withColumn("_x", -x if descending else x)
    marks = s.select(F.percentile_approx("_x", steps, 100 * RANGES)).scalar()
    ties = s.select(F.percentile_approx(tie, steps, 100 * RANGES)).scalar()
    s = s.withColumns({"_marks": marks, "_ties": ties})
    often = F.size(F.filter("_marks", lambda m: m == F.col("_x"))) > 1
    s = s.withColumn("_r", F.coalesce(_range_of(F.col("_x"), F.col("_marks")), F.lit(-1))).withColumn(
        "_t", F.when(often, 1 + F.coalesce(_range_of(F.col(tie), F.col("_ties")), F.lit(0))).otherwise(0)
    ).drop("_marks", "_ties")
    inside = Window.partitionBy("_r", "_t").orderBy("_x", tie)
    before = Window.orderBy("_r", "_t").rowsBetween(Window.unboundedPreceding, -1)
    ranges = s.groupBy("_r", "_t").agg(F.count("*").alias("_n"), F.sum(F.col(sum_col) if sum_col else F.lit(0)).alias("_s"))
    offsets = ranges.select("_r", "_t", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off_n"),
                            F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off_s"))
    out = s.withColumn("position", F.row_number().over(inside))
    if sum_col:
        out = out.withColumn("running_sum", F.sum(sum_col).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.join(F.broadcast(offsets), ["_r", "_t"]).withColumn(
        "position", (F.col("_off_n") + F.col("position")).cast("long"))
    if sum_col:
        out = out.withColumn("running_sum", F.col("_off_s") + F.col("running_sum"))
    return out.drop("_x", "_r", "_t", "_off_n", "_off_s")


def concentration_curve(profile: DataFrame) -> DataFrame:
    """Cumulative value over items sorted by value ascending (tie: itemID)."""
    g = global_order(profile.select("itemID", "total_value"), "total_value", sum_col="total_value")
    return g.select("itemID", "total_value", "position",
                    F.col("running_sum").alias("cum_value"))


def ranked_profile(profile: DataFrame, by: str = "total_value") -> DataFrame:
    """Items ranked by ``by`` descending (tie: itemID), with position."""
    g = global_order(profile.select("itemID", by), by, descending=True)
    return g.select("itemID", by, F.col("position").alias("rank"))


# --- O2, O3, O4 ----------------------------------------------------------------------------

def top_k(df: DataFrame, by: str, k: int = 50, tie: str = "itemID") -> DataFrame:
    """O2: the ``k`` rows with the largest ``by`` (tie-break ascending ``tie``)."""
    return df.orderBy(F.desc_nulls_last(by), F.asc(tie)).limit(k)


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    """O3: first ``n`` rows in the order of all columns (a total order, so the
    preview is the same on every run)."""
    return df.orderBy(*df.columns).limit(n)


def seeded_sample(df: DataFrame, n: int, seed: int, key=("itemID",)) -> DataFrame:
    """``n`` rows chosen by the md5 of (key, seed), where ``key`` tells the rows
    apart: the same rows on any partitioning and in any engine with md5. A
    top-n, so only n rows per task travel to the final merge."""
    u = md5_uniform(*key, F.lit(seed))
    return df.withColumn("_u", u).orderBy("_u", *key).limit(n).drop("_u")


def line_key() -> list[Column]:
    """Item, time and price in cents of an order line as text parts that any engine writes alike."""
    return [F.col("itemID"), F.date_format("time", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
            F.rint(F.col("salesPrice") * 100).cast("long")]


def sample_items(df: DataFrame, n: int, seed: int, key: str = "itemID") -> DataFrame:
    """O4 + P15: ``n`` distinct keys chosen by seeded md5."""
    return seeded_sample(df.select(key).distinct(), n, seed, (key,))


# --- Q1-Q8 ---------------------------------------------------------------------------------

def numeric_summary(df: DataFrame, cols=None, qs=(0.25, 0.5, 0.75)) -> DataFrame:
    """Q1: count, mean, std, min, quartiles (exact, linear interpolation), max per
    numeric column, one row per column.

    The columns are stacked as (column, x) and counted per distinct value, a
    partial aggregate; everything after works on distinct values with their
    counts. Values are cut into ``RANGES`` ranges of each column, whose counts give
    every range its start; only the ranges that hold a quantile's neighbours are
    then numbered value by value. ``RANGES`` are equal steps between quantile marks
    of a sketch, so a range holds few distinct values whatever their distribution.
    """
    numeric = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, numeric) and f.name != "lines"]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x"))
                      for c in cols])
    counts = (df.select(F.inline(cells), line_weight(df).cast("long").alias("w"))
              if "lines" in df.columns else df.select(F.inline(cells)).withColumn("w", F.lit(1).cast("long")))
    counts = counts.groupBy("column", "x").agg(F.sum("w").alias("n"))
    known = F.sum(F.when(F.col("x").isNotNull(), F.col("n")).otherwise(0))
    means = counts.groupBy("column").agg(
        known.alias("count"), safe_div(F.sum(F.col("x") * F.col("n")), known).alias("mean"),
        F.min("x").alias("min"), F.max("x").alias("max"),
        F.percentile_approx("x", [k / RANGES for k in range(1, RANGES)], 10 * RANGES).alias("_marks"))
    # one row per column: bounded by the schema
    marked = counts.join(F.broadcast(means), "column")
    square = F.sum(F.col("n") * (F.col("x") - F.col("mean")) * (F.col("x") - F.col("mean")))
    base = marked.groupBy("column", "count", "mean", "min", "max").agg(
        F.sqrt(safe_div(square, F.when(F.col("count") > 1, F.col("count") - 1))).alias("std"))
    ranged = marked.where(F.col("x").isNotNull()).withColumn("_range", _range_of(F.col("x"), F.col("_marks")))
    before = Window.partitionBy("column").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("column", "count", "_range").agg(F.sum("n").alias("_n")).withColumn(
        "_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    wanted = F.lit(False)
    for q in qs:
        p = F.lit(q) * (F.col("count") - 1)
        wanted = wanted | ((F.floor(p) + 1 <= F.col("_start") + F.col("_n")) & (F.ceil(p) + 1 > F.col("_start")))
    # at most two ranges per quantile and column
    inside = Window.partitionBy("column", "_range").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (ranged.join(F.broadcast(starts.where(wanted).select("column", "_range", "_start")), ["column", "_range"])
              .withColumn("_to", F.col("_start") + F.sum("n").over(inside)))
    first, last = F.col("_to") - F.col("n") + 1, F.col("_to")
    parts = []
    for q in qs:
        p = F.lit(q) * (F.col("count") - 1)
        lo, hi, frac = F.floor(p) + 1, F.ceil(p) + 1, p - F.floor(p)
        term = (F.when((first <= lo) & (lo <= last), F.col("x") * (F.lit(1.0) - frac)).otherwise(0.0)
                + F.when((first <= hi) & (hi <= last), F.col("x") * frac).otherwise(0.0))
        parts.append(F.sum(term).alias(f"p{int(round(q * 100))}"))
    quant = ranked.groupBy("column").agg(*parts)
    return base.join(quant, "column", "left").select(
        "column", "count", "mean", "std", "min", *[f"p{int(round(q * 100))}" for q in qs], "max")


def string_summary(df: DataFrame, cols=None) -> DataFrame:
    """Q2: per string column count, unique, top (most frequent, tie: smallest), freq."""
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    outs = []
    for c in cols:
        freq = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(
            F.count("*").alias("n"))
        top = freq.agg(F.count("*").alias("unique"), F.sum("n").alias("count"),
                       F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("top"),
                       F.max("n").alias("freq"))
        outs.append(top.select(F.lit(c).alias("column"), "count", "unique", "top", "freq"))
    return reduce(DataFrame.unionByName, outs)


def column_inventory(df: DataFrame) -> DataFrame:
    """Q3: per column its type and number of non-NULL values."""
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    rows = F.array(*[F.struct(F.lit(f.name).alias("column"),
                              F.lit(f.dataType.simpleString()).alias("type"),
                              F.col(f.name).alias("non_null")) for f in df.schema.fields])
    return counts.select(F.inline(rows))


def uniqueness_check(infos: DataFrame, items: DataFrame) -> DataFrame:
    """Q4: infos has one row per item and as many rows as items."""
    per = infos.groupBy("itemID").agg(F.count("*").alias("n"))
    a = per.agg(F.sum("n").cast("long").alias("infos_rows"), F.max("n").alias("max_per_item"))
    b = items.agg(F.count("*").alias("items_rows"))
    stacked = a.select("infos_rows", "max_per_item", F.lit(None).cast("long").alias("items_rows")) \
        .unionByName(b.select(F.lit(None).cast("long").alias("infos_rows"),
                              F.lit(None).cast("long").alias("max_per_item"), "items_rows"))
    s = stacked.agg(F.max("infos_rows").alias("infos_rows"),
                    F.max("max_per_item").alias("max_per_item"),
                    F.max("items_rows").alias("items_rows"))
    return s.withColumn("unique_items", F.col("max_per_item") == 1) \
        .withColumn("same_count", F.col("infos_rows") == F.col("items_rows"))


def referential_check(infos: DataFrame, items: DataFrame) -> DataFrame:
    """Q5: infos items missing from items (D3 done properly): count, and ok flag."""
    missing = infos.select("itemID").join(items.select("itemID"), "itemID", "left_anti")
    return missing.agg(F.count("*").alias("n_missing")).withColumn(
        "all_known", F.col("n_missing") == 0)


def reconciliation(txn: DataFrame, matrix: DataFrame) -> DataFrame:
    """Q6: per item the line total, the matrix total, and whether they agree within
    ``1e-8 + 1e-9 * |matrix|``."""
    a = txn.groupBy("itemID").agg(F.coalesce(exact_sum(_value(txn)), F.lit(0.0)).alias("s1"))
    b = matrix.groupBy("itemID").agg(exact_sum("total_values").alias("s2"))
    s1, s2 = F.coalesce("s1", F.lit(0.0)), F.coalesce("s2", F.lit(0.0))
    return a.join(b, "itemID", "full_outer").withColumn(
        "ok", F.abs(s1 - s2) <= F.lit(1e-8) + F.lit(1e-9) * F.abs(s2))


def shape(df: DataFrame) -> DataFrame:
    """Q8: row and column count."""
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))
