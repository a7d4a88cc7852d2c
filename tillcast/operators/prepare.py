"""Transaction preparation: split, cleaning, promotion flags, prices and discounts.

Scale rule for this module: a single item may hold a third of all order lines,
so nothing here partitions order lines by item alone. Equal lines are counted
first (:func:`line_kinds`; every function takes rows with or without ``lines``), item-level
facts are grouped aggregates, and they are joined back by :func:`spread_join`, which deals an
item's rows to several places; running statistics over an item's lines are taken
over their kinds, in slices of time (see :func:`running_max_promotion`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcast.functions import (discount_amount, discount_share, exact_sum,
                                is_nonzero, line_weight, round2, safe_div)
from tillcast.sources.fixtures import Calendar

ITEM = ["split", "itemID"]
#: Places that the rows of one key are dealt to in a join with one row per key.
SPREAD = 16


def line_kinds(txn: DataFrame) -> DataFrame:
    """Equal order lines as one row with their number, ``lines``."""
    return txn.groupBy(*txn.columns).agg(F.count("*").alias("lines"))


def single_lines(kinds: DataFrame) -> DataFrame:
    """The order lines one by one again."""
    if "lines" not in kinds.columns:
        return kinds
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("lines")))
    return kinds.select(*[c for c in kinds.columns if c != "lines"], copies.alias("_copy")).drop("_copy")


def spread_join(rows: DataFrame, facts: DataFrame, keys, how: str = "left", hint: str = "merge") -> DataFrame:
    """Join rows with one row of facts per key, where a key may hold a third of the rows.

    A row goes to one of ``SPREAD`` places of its key by a hash of the row, and the facts
    to all of them. As the join is not by the key alone, whatever aggregates its
    result by key has an exchange of its own (with partial sums before it), and adaptive
    execution may split a hot place further. The facts are never broadcast: Spark's estimate
    doesn't count the ``SPREAD`` copies, so that facts just small enough would fill the driver.
    """
    placed = rows.withColumn("_place", F.pmod(F.xxhash64(*rows.columns), F.lit(SPREAD)))
    every = facts.withColumn("_place", F.explode(F.sequence(
        F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    return placed.join(every.hint(hint), [*keys, "_place"], how).drop("_place")


# --- P1-P5 -------------------------------------------------------------------

def add_split(txn: DataFrame, cal: Calendar) -> DataFrame:
    """P2 + P3: calendar date of each line and ``split`` (train up to the split date)."""
    date = F.to_date("time")
    return (txn.withColumn("date", date)
            .withColumn("split", F.when(F.col("date") <= F.lit(cal.split_date).cast("date"),
                                        F.lit("train")).otherwise(F.lit("test"))))


def drop_zero_prices(txn: DataFrame) -> DataFrame:
    """Remove lines sold at price 0 (missing prices are kept, as in pandas)."""
    return txn.where(is_nonzero("salesPrice"))


def positive_prices(txn: DataFrame) -> DataFrame:
    """P4, exploration form: keep lines with a price above 0 (drops missing)."""
    return txn.where(F.col("salesPrice") > 0)


def add_order_value(txn: DataFrame) -> DataFrame:
    """P5: ``orderValue = order * salesPrice``."""
    return txn.withColumn("orderValue", F.col("order") * F.col("salesPrice"))


def prepared_transactions(txn: DataFrame, cal: Calendar) -> DataFrame:
    """Split, zero prices removed, order value added."""
    return add_order_value(drop_zero_prices(add_split(txn, cal)))


# --- W1, W2, W4 and F2 on order lines ---------------------------------------------

def item_price_stats(txn: DataFrame, keys=ITEM) -> DataFrame:
    """Per item (and split): maximum, minimum and number of distinct prices."""
    return txn.groupBy(*keys).agg(
        F.max("salesPrice").alias("maxPrice"),
        F.min("salesPrice").alias("minPrice"),
        F.count_distinct("salesPrice").alias("item_prices_count"))


def enrich_transactions(txn: DataFrame, keys=ITEM) -> DataFrame:
    """Order lines with item max/min price, promotion flag and discount.

    ``promotion`` is 1 when the line price is below the item's maximum over the
    whole split. The item statistics are one row per item, joined back by
    :func:`spread_join`.
    """
    out = spread_join(txn, item_price_stats(txn, keys), keys)
    amount = discount_amount("maxPrice", "salesPrice")
    return (out
            .withColumn("promotion",
                        F.coalesce((F.col("salesPrice") < F.col("maxPrice")).cast("int"),
                                   F.lit(0)))
            .withColumn("discountAmount", amount)
            .withColumn("discountPerc", discount_share(F.col("discountAmount"), "maxPrice")))


def price_levels(txn: DataFrame, keys=ITEM) -> DataFrame:
    """Order lines reduced to (item, price) levels: units, value and line count,
    with the item maximum, the promotion flag and the discount of the level.

    Every line-level statistic that depends only on the line's price and its
    item (promotion share, discount histogram and extremes, per-transaction
    means) can be computed from this grain, with line counts as weights,
    instead of joining each line to its item: a partial aggregate, then a
    join of the price levels with their item's maximum.
    """
    n = line_weight(txn)
    lv = txn.groupBy(*keys, "salesPrice").agg(
        F.sum(F.col("order") * n).cast("long").alias("units"),
        F.coalesce(exact_sum(F.col("order") * F.col("salesPrice") * n), F.lit(0.0)).alias("value"),
        F.sum(n).cast("long").alias("lines"))
    top = lv.groupBy(*keys).agg(F.max("salesPrice").alias("maxPrice"))
    return (spread_join(lv, top, keys)
            .withColumn("promotion",
                        F.coalesce((F.col("salesPrice") < F.col("maxPrice")).cast("int"),
                                   F.lit(0)))
            .withColumn("discountAmount", discount_amount("maxPrice", "salesPrice"))
            .withColumn("discountPerc", discount_share(F.col("discountAmount"), "maxPrice")))


def running_max_promotion(txn: DataFrame, keys=ITEM, bucket: str = "minute") -> DataFrame:
    """``in_promotion_hist`` = price below the item's running maximum.

    The running maximum covers every line of the item with a time up to and
    including the line's own time (lines with equal times are peers, so the
    result does not depend on file order).

    Equal lines are counted first, and every step works on their kinds. These are cut into
    ``bucket`` slices of an item's time: the maximum of all earlier slices is a window over slice rows,
    joined to the kinds by item and slice, and only the kinds of one slice of one item are ordered in a
    task. The slices are as many as the kinds where sales are sparse, so they are never broadcast.
    A line without an item or a time has no running maximum.
    """
    kinds = (txn if "lines" in txn.columns else line_kinds(txn)).withColumn("_bucket", F.date_trunc(bucket, F.col("time")))
    bkeys = [*keys, "_bucket"]
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    slices = kinds.groupBy(*bkeys).agg(F.max("salesPrice").alias("_bmax")).select(
        *bkeys, F.max("_bmax").over(before).alias("_prev_max"))
    within = Window.partitionBy(*bkeys).orderBy("time").rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    known = F.col("time").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    out = (kinds.join(slices.hint("merge"), bkeys, "left")
           .withColumn("_in", F.max("salesPrice").over(within))
           .withColumn("runningMaxPrice", F.when(known, F.greatest("_prev_max", "_in")))
           .withColumn("in_promotion_hist",
                       F.coalesce((F.col("salesPrice") < F.col("runningMaxPrice")).cast("int"),
                                  F.lit(0))).drop("_bucket", "_prev_max", "_in"))
    return out if "lines" in txn.columns else single_lines(out)


def promotion_vs_retail_price(txn: DataFrame, items: DataFrame) -> DataFrame:
    """``in_promotion_rrp`` = price below the item's recommended retail price."""
    rrp = items.select("itemID", "recommendedRetailPrice")
    return (spread_join(txn, rrp, ["itemID"])
            .withColumn("in_promotion_rrp",
                        F.coalesce((F.col("salesPrice") < F.col("recommendedRetailPrice"))
                                   .cast("int"), F.lit(0))))


# --- A6, F3, J1: discount levels and the simulation price --------------------------

def median_discount(train_txn: DataFrame) -> DataFrame:
    """Per item, median of the distinct non-zero discount shares, rounded to 2.

    The discount of a line depends only on (item maximum, line price), so the
    distinct levels come from distinct (item, price) pairs: a partial aggregate
    that stays small however many lines a hot item has.
    """
    prices = train_txn.select("itemID", "salesPrice").distinct()
    top = prices.groupBy("itemID").agg(F.max("salesPrice").alias("maxPrice"))
    levels = (spread_join(prices, top, ["itemID"])
              .withColumn("discountAmount", discount_amount("maxPrice", "salesPrice"))
              .withColumn("discountPerc", discount_share(F.col("discountAmount"), "maxPrice"))
              .where(is_nonzero("discountAmount"))
              .select("itemID", "discountPerc").distinct())
    return levels.groupBy("itemID").agg(round2(F.median("discountPerc")).alias("medianDiscPerc"))


def discount_stats(items: DataFrame, train_txn: DataFrame) -> DataFrame:
    """All items with their median discount (NULL for items never discounted)."""
    return items.select("itemID").join(median_discount(train_txn), "itemID", "left")


def infos_with_discount(infos: DataFrame, items: DataFrame, train_txn: DataFrame) -> DataFrame:
    """J1 + F3: infos with ``medianDiscPerc`` and the discounted simulation price.

    ``discountedPrice`` is set only for items with a promotion in the
    simulation period: ``round(simulationPrice * (1 - medianDiscPerc), 2)``.
    """
    stats = discount_stats(items, train_txn)
    return (infos.join(stats, "itemID", "left")
            .withColumn("discountedPrice",
                        F.when(F.col("promotion").isNotNull(),
                               round2(F.col("simulationPrice") * (1 - F.col("medianDiscPerc"))))))


# --- A4, A5, A7, A21 -----------------------------------------------------------

def price_variations(txn: DataFrame) -> DataFrame:
    """A4: (item, day) pairs sold at more than one distinct price."""
    return (txn.groupBy("itemID", "date")
            .agg(F.count_distinct("salesPrice").alias("unique_price_count"))
            .where(F.col("unique_price_count") > 1))


def several_price_share(txn: DataFrame, items: DataFrame) -> DataFrame:
    """A5: several-price (item, day) pairs per item in % (``pairs_per_item_pct``),
    and their share of all sold (item, day) pairs in % (``pairs_share_pct``)."""
    pairs = txn.groupBy("itemID", "date").agg(
        F.count_distinct("salesPrice").alias("n_prices"))
    # one pass over both inputs: pair rows and item rows stacked, counted apart
    stacked = pairs.select((F.col("n_prices") > 1).cast("long").alias("m"),
                           F.lit(1).cast("long").alias("p"), F.lit(0).cast("long").alias("i")
                           ).unionByName(
        items.select(F.lit(0).cast("long").alias("m"), F.lit(0).cast("long").alias("p"),
                     F.lit(1).cast("long").alias("i")))
    counts = stacked.agg(F.sum("m").alias("multi_pairs"), F.sum("p").alias("all_pairs"),
                         F.sum("i").alias("n_items"))
    return counts.select(
        "multi_pairs", "all_pairs", "n_items",
        (safe_div(F.col("multi_pairs"), F.col("n_items")) * 100).alias("pairs_per_item_pct"),
        (safe_div(F.col("multi_pairs"), F.col("all_pairs")) * 100).alias("pairs_share_pct"))


#: Ranges that the values of a key are cut into by :func:`exact_median`.
RANGES = 64


def exact_median(levels: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """(key, median): the exact median of each key's values, which may be many and all different for a hot key.

    Quantile marks of a bounded sketch cut the distinct values of a key into ``RANGES`` ranges; their counts
    say which one or two ranges hold the middle, and only the values of these are put in
    order. No buffer holds a key's values, and a hot key's rows are spread (:func:`spread_join`) until
    only its middle ranges are left.
    """
    known = levels.where(F.col(value).isNotNull()).select(key, value, weight)
    marks = known.groupBy(key).agg(F.sum(weight).alias("_all"), F.percentile_approx(
        value, [k / RANGES for k in range(1, RANGES)], 10 * RANGES).alias("_marks"))
    x = F.col(value)
    ranged = spread_join(known, marks, [key], "inner").select(
        key, value, weight, "_all", F.size(F.filter("_marks", lambda m: m < x)).alias("_range"))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(key, "_range", "_all").agg(F.sum(weight).alias("_n")).withColumn(
        "_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))  # RANGES rows a key at most
    low, high = F.floor((F.col("_all") - 1) / 2) + 1, F.floor(F.col("_all") / 2) + 1
    middle = starts.where((F.col("_start") + F.col("_n") >= low) & (F.col("_start") < high)).select(key, "_range", "_start")
    upto = Window.partitionBy(key, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranged.join(middle, [key, "_range"]).withColumn("_to", F.col("_start") + F.sum(weight).over(upto))
    first, last = F.col("_to") - F.col(weight) + 1, F.col("_to")

    def at(rank):
        return F.max(F.when((first <= rank) & (rank <= last), x))

    return ranked.groupBy(key).agg(((at(low) + at(high)) / 2).alias("median"))


def mean_median_gap(txn: DataFrame) -> DataFrame:
    """Per item mean and median price, absolute and % gap, all rounded to 2, from
    price levels with line counts."""
    levels = txn.groupBy("itemID", "salesPrice").agg(F.sum(line_weight(txn)).cast("long").alias("n"))
    known = F.when(F.col("salesPrice").isNotNull(), F.col("n"))
    means = levels.groupBy("itemID").agg(
        safe_div(exact_sum(F.col("salesPrice") * F.col("n")), F.sum(known)).alias("mean_price"))
    medians = exact_median(levels, "itemID", "salesPrice", "n").withColumnRenamed("median", "median_price")
    stats = means.join(medians, "itemID", "left")
    diff = F.abs(F.col("mean_price") - F.col("median_price"))
    pct = F.abs(safe_div(diff, F.col("median_price"))) * 100
    return stats.select("itemID", round2("mean_price").alias("mean_price"),
                        round2("median_price").alias("median_price"),
                        round2(diff).alias("abs_diff"), round2(pct).alias("abs_perc_diff"))


def discount_extremes(levels: DataFrame) -> DataFrame:
    """Largest discount share and smallest non-zero discount share (over
    order lines or, equally, over their price levels)."""
    return levels.agg(
        F.max("discountPerc").alias("max_discount"),
        F.min(F.when(is_nonzero("discountPerc"), F.col("discountPerc"))).alias(
            "min_nonzero_discount"))
