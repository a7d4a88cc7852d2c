"""Time-series features over the dense grid: lags, rolling statistics, running sums,
Fourier harmonics, calendar fields, noise columns (W6-W11, T3-T5, F6-F8, P8, P13).

All windows are partitioned by (split, item) and ordered by date, so they share
one partitioning and one sort; a partition holds one item's series, whose
length is the calendar length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.functions import (gaussian_pair, month_day, round2, round_half_even,
                                week_of_month_calendar, weekday_mon1)
from tillcast.schemas import LAGS, N_HARMONICS, ROLLING_DAYS

ITEM = ["split", "itemID"]


def series_window(keys=ITEM, order: str = "date") -> Window:
    return Window.partitionBy(*keys).orderBy(order)


def _frame(keys, lo, hi, order="date") -> Window:
    return series_window(keys, order).rowsBetween(lo, hi)


def _middle(arr: Column, n: Column) -> Column:
    """Median of a sorted array of ``n`` elements (mean of the two middle ones if even)."""
    lo = F.element_at(arr, (F.floor((n - 1) / 2) + 1).cast("int"))
    hi = F.element_at(arr, (F.floor(n / 2) + 1).cast("int"))
    return (lo.cast("double") + hi.cast("double")) / 2


# --- W6 ---------------------------------------------------------------------------------

def lag_columns(col: str, lags=LAGS, prefix: str | None = None, keys=ITEM) -> list[Column]:
    """``{prefix}_lag{k}`` = value k rows earlier in the item's series."""
    w = series_window(keys)
    prefix = prefix or col
    return [F.lag(col, k).over(w).alias(f"{prefix}_lag{k}") for k in lags]


def add_lags(df: DataFrame, col: str, lags=LAGS, prefix: str | None = None,
             keys=ITEM) -> DataFrame:
    """W6 as a transformation of ``df``."""
    return df.select("*", *lag_columns(col, lags, prefix, keys))


# --- W7, W8, W10, W9, W11 ---------------------------------------------------------------

def rolling_previous(col: str, n: int = 7, keys=ITEM):
    """W7 + W8: mean, sample std and median of the ``n`` rows before the current
    one; NULL until ``n`` values exist (pandas ``shift(1).rolling(n)``)."""
    f = _frame(keys, -n, -1)
    full = F.count(col).over(f) == n
    srt = F.sort_array(F.collect_list(col).over(f))
    return (F.when(full, F.avg(col).over(f)),
            F.when(full, F.stddev_samp(col).over(f)),
            F.when(full, _middle(srt, F.lit(n))))


def add_rolling(df: DataFrame, col: str = "qty_sold", n: int = 7, keys=ITEM,
                prefix: str = "rolling_qty_sold") -> DataFrame:
    mean, std, med = rolling_previous(col, n, keys)
    return (df.withColumn(f"{prefix}_mean", mean)
            .withColumn(f"{prefix}_std", std)
            .withColumn(f"{prefix}_median", med))


def rolling_median_distinct(col: str, n: int = 7, keys=ITEM) -> Column:
    """Median of the distinct values among the ``n`` previous rows."""
    f = _frame(keys, -n, -1)
    arr = F.sort_array(F.collect_set(col).over(f))
    return F.when(F.count(col).over(f) == n, _middle(arr, F.size(arr)))


def rolling_mean_current(col: str, n: int = 14, keys=ITEM, order: str = "date") -> Column:
    """Mean of the last ``n`` rows including the current one; NULL until full."""
    f = _frame(keys, -(n - 1), 0, order)
    return F.when(F.count(col).over(f) == n, F.avg(col).over(f))


def cumulative_sum(col: str = "qty_sold", keys=ITEM, exclude_current: bool = False) -> Column:
    """Running sum in date order; ``exclude_current`` stops one row earlier
    so the value does not contain the target of the same day."""
    hi = -1 if exclude_current else 0
    s = F.sum(col).over(_frame(keys, Window.unboundedPreceding, hi))
    return F.coalesce(s, F.lit(0)).cast("long") if exclude_current else s.cast("long")


# --- T3, T4 -----------------------------------------------------------------------------

def harmonic(col: str, k: int, pos: Column, length: Column, keys=ITEM) -> Column:
    """Fourier component ``k`` of the item's series, back in the time domain.

    For a series x of length L and 0-based position t, with w = 2 pi k / L:
    ``c * (cos(w t) * SUM(x cos(w t)) + sin(w t) * SUM(x sin(w t)))``,
    c = 2/L, or 1/L when 2k = L (the Nyquist bin is its own mirror). This is the
    inverse FFT of bins k and -k. NULL when k >= L.
    """
    w_item = Window.partitionBy(*keys)
    omega = F.lit(2 * math.pi * k) / length
    cos_t = F.cos(omega * pos)
    sin_t = F.sin(omega * pos)
    c_sum = F.sum(F.col(col) * cos_t).over(w_item)
    s_sum = F.sum(F.col(col) * sin_t).over(w_item)
    scale = F.when(length == 2 * k, F.lit(1.0) / length).otherwise(F.lit(2.0) / length)
    return F.when(length > k, scale * (cos_t * c_sum + sin_t * s_sum))


def add_harmonics(df: DataFrame, col: str = "qty_sold", n: int = 5, pos: Column | None = None,
                  length: Column | None = None, keys=ITEM) -> DataFrame:
    """T3 for components 1..n as ``harmonic_0`` .. ``harmonic_{n-1}``.

    ``pos`` and ``length`` default to the row number and row count of the series.
    On a gap-free grid they are plain date arithmetic, which needs no window.
    """
    if pos is None:
        df = df.withColumn("_t", (F.row_number().over(series_window(keys)) - 1).cast("double"))
        pos = F.col("_t")
    if length is None:
        df = df.withColumn("_L", F.count("*").over(Window.partitionBy(*keys)).cast("double"))
        length = F.col("_L")
    for i in range(n):
        df = df.withColumn(f"harmonic_{i}", harmonic(col, i + 1, pos, length, keys))
    return df.drop("_t", "_L")


def harmonic_smoothing(df: DataFrame, col: str = "qty_sold", n: int = 10, keys=ITEM,
                       out: str = "harmonic_smooth") -> DataFrame:
    """T4: item mean plus the sum of the first ``n`` components; NULL for a series of ``n`` days or fewer.

    An item's days are gathered in one sorted array. One fold over it carries a Goertzel recurrence per component,
    ``a_t = x_t + 2 cos(w) a_{t-1} - a_{t-2}``, whose last two values give both sums of the component, so neither
    pass over the days has a window or a shuffle of its own, and cosines are taken once a component in the fold.
    """
    more = [c for c in df.columns if c not in keys]
    rows = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(
        F.col("date"), *[F.col(c) for c in more if c != "date"]))).alias("_s"))
    size = F.size("_s").cast("double")
    rows = rows.withColumn("_w", F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.struct(
        (F.lit(2 * math.pi) * k / size).alias("w"),
        F.when(size == 2 * k, F.lit(1.0) / size).otherwise(F.lit(2.0) / size).alias("c"))))
    x = F.transform("_s", lambda e: e.getField(col).cast("double"))
    rows = rows.withColumn("_x", x).withColumn("_k", F.transform("_w", lambda c: F.lit(2.0) * F.cos(c.getField("w"))))
    zero = F.transform("_w", lambda _: F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b")))
    states = F.aggregate("_x", zero, lambda acc, v: F.zip_with(acc, F.col("_k"), lambda st, k: F.struct(
        (v + k * st.getField("a") - st.getField("b")).alias("a"), st.getField("a").alias("b"))))

    def sums(st: Column, c: Column) -> Column:
        w, a = c.getField("w"), st.getField("a")
        return F.struct(w.alias("w"), (c.getField("c") * (F.cos(w) * a - st.getField("b"))).alias("cos"),
                        (c.getField("c") * -F.sin(w) * a).alias("sin"))

    rows = rows.withColumn("_c", F.zip_with(states, F.col("_w"), sums)).withColumn(
        "_mean", F.aggregate("_x", F.lit(0.0), lambda a, v: a + v) / size)

    def day(e: Column, t: Column) -> Column:
        smooth = F.aggregate("_c", F.col("_mean"), lambda a, c: a + F.cos(c.getField("w") * t) * c.getField("cos")
                             + F.sin(c.getField("w") * t) * c.getField("sin"))
        return F.struct(e.alias("e"), F.when(size > n, smooth).alias("v"))

    return rows.select(*keys, F.inline(F.transform("_s", day))).select(
        *[F.col(c) if c in keys else F.col(f"e.{c}").alias(c) for c in df.columns], F.col("v").alias(out))


# --- W6-W8, W11, T3 of a grid, from its sold days ------------------------------------------

#: Columns that :func:`sold_day_series` adds to the sold days, for :func:`grid_series_columns`.
SERIES_COLUMNS = ("_sold", "_q", "_v", "_p", "_gap_price", "_sum", "_cos", "_sin")


def sold_day_series(sold: DataFrame, first: Column, last: Column, length: Column, reach: int = ROLLING_DAYS,
                    n_harmonics: int = N_HARMONICS, keys=ITEM) -> DataFrame:
    """What the days behind a sold day need to know of their series, one row per sold day (a row of
    :func:`~tillcast.operators.grid.dense_grid` before its gaps are written).

    ``_q`` holds the units of the ``reach`` days before the day, of the day itself and of the ``reach`` days of a gap,
    oldest first; ``_v`` and ``_p`` value and price each of the day and of the 1 .. ``reach`` days before it, NULL on days
    without a sale; ``_sum`` the units up to the day, ``_cos`` and ``_sin`` the series' Fourier sums, to which a gap
    adds nothing. Sales outside first .. last count nowhere.
    """
    inside, zero = F.col("date").between(first, last), F.lit(0).cast("long")
    pos = F.datediff("date", first).cast("double")
    sold = sold.withColumns({
        "_sold": F.col("date"), "_at": F.datediff("date", first).cast("long"),
        "_q0": F.when(inside, F.coalesce("qty_sold", zero)),
        "_v0": F.when(inside, F.coalesce("sales_value", F.lit(0.0))),
        "_p0": F.when(inside, round2(F.coalesce("PricePerEachToday", "_ppe_fill"))),
        "_gap_price": round2("_ppe_fill")})
    w_item, by_date = Window.partitionBy(*keys), series_window(keys, "_at")

    def before(c: str) -> list[Column]:
        return [F.col(c), *[F.max(c).over(by_date.rangeBetween(-m, -m)) for m in range(1, reach + 1)]]

    def sums(wave) -> Column:
        return F.array(*[F.coalesce(F.sum(F.col("_q0") * wave(F.lit(2 * math.pi * k) / length * pos)).over(w_item), F.lit(0.0))
                         for k in range(1, n_harmonics + 1)])

    return sold.withColumns({
        "_q": F.array(*[F.coalesce(c, zero) for c in reversed(before("_q0"))], *[zero] * reach),
        "_v": F.array(*before("_v0")), "_p": F.array(*before("_p0")),
        "_sum": F.coalesce(F.sum("_q0").over(by_date.rowsBetween(Window.unboundedPreceding, 0)), zero),
        }).withColumns({"_cos": sums(F.cos), "_sin": sums(F.sin)}).drop("_at", "_q0", "_v0", "_p0")


def numbered_copies(items: DataFrame) -> DataFrame:
    """The items with ``_copy`` (from 0) and ``_copies`` of their key: one of several copies has its own row a day."""
    w = Window.partitionBy("itemID")
    return items.select("*", (F.row_number().over(w.orderBy(*items.columns)) - 1).alias("_copy"),
                        F.count("*").over(w).cast("int").alias("_copies"))


def grid_series_columns(g: DataFrame, first: Column, length: Column, lags=LAGS, n: int = ROLLING_DAYS,
                        n_harmonics: int = N_HARMONICS, exclude_current: bool = False) -> DataFrame:
    """Lags, rolling statistics, running sum and harmonics of the days of a gap-free grid, each from the columns that
    :func:`sold_day_series` left on its row: no window over the grid, so it is neither sorted nor held.

    The values are those of :func:`lag_columns`, :func:`rolling_previous`, :func:`cumulative_sum` and
    :func:`harmonic` over the grid's rows. These go by rows: of an item with several copies
    (:func:`numbered_copies`) a day has as many, so fewer days lie between a row and the k-th before it.
    """
    zero, one = F.lit(0).cast("long"), F.lit(1)
    g = g.withColumns({"_t": F.datediff("date", first), "_o": F.datediff("date", "_sold"),
                       "_copy": F.coalesce("_copy", F.lit(0)), "_copies": F.coalesce("_copies", one)})
    single = F.col("_copies") == 1

    def back(k: Column) -> Column:
        """How many days the k-th row before lies back."""
        return F.when(single, k).otherwise(F.floor((k - F.col("_copy") + F.col("_copies") - 1) / F.col("_copies")).cast("int"))

    # units of the n rows before; none was sold before the first sold day or more than n days behind another
    g = g.withColumn("_w", F.when(single, F.slice("_q", F.when(F.col("_o").between(0, n), F.col("_o")).otherwise(n + 1) + 1, n))
                     .otherwise(F.transform(F.array(*[F.lit(k) for k in range(n, 0, -1)]), lambda k: F.coalesce(
                         F.get("_q", F.lit(n) + F.col("_o") - back(k)), zero))))
    day = [F.get("_w", F.lit(i)) for i in range(n)]

    def lagged(c: str, name: str, gap: Column) -> dict:
        return {f"{name}_lag{k}": F.when(F.col("_t") >= back(F.lit(k)), F.coalesce(F.get(c, back(F.lit(k)) - F.col("_o")), gap))
                for k in lags}

    def step(at: Column, x: Column) -> Column:
        """Sample variance as Spark's own aggregate adds it up, so the same doubles come out."""
        size, delta = at["n"] + 1.0, x.cast("double") - at["mean"]
        return F.struct(size.alias("n"), (at["mean"] + delta / size).alias("mean"),
                        (at["m2"] + delta * (delta - delta / size)).alias("m2"))

    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    std = F.when(F.array_min("_w") == F.array_max("_w"), F.lit(0.0)).otherwise(
        F.aggregate("_w", start, step, lambda at: F.sqrt(at["m2"] / F.lit(n - 1.0))))
    full = F.col("_t") >= back(F.lit(n))
    pos = F.col("_t").cast("double")
    until = F.when(F.col("_o") > 0, F.col("_sum")).otherwise(F.col("_sum") - F.get("_q", F.lit(n)))
    scale = lambda k: F.when(length == 2 * k, F.lit(1.0) / length).otherwise(F.lit(2.0) / length)
    wave = lambda k: F.lit(2 * math.pi * k) / length * pos
    return g.withColumns({
        "cum_sum_order": until * F.col("_copies") + F.col("qty_sold") * (F.col("_copy") + (0 if exclude_current else 1)),
        "rolling_qty_sold_mean": F.when(full, sum([x.cast("double") for x in day[1:]], day[0].cast("double")) / F.lit(float(n))),
        "rolling_qty_sold_std": F.when(full, std),
        "rolling_qty_sold_median": F.when(full, _middle(F.sort_array("_w"), F.lit(n))),
        **{f"qty_sold_lag{k}": F.when(F.col("_t") >= back(F.lit(k)), day[n - k]) for k in lags},
        **lagged("_v", "sales_value", F.lit(0.0)), **lagged("_p", "PricePerEach", F.col("_gap_price")),
        **{f"harmonic_{k - 1}": F.when(length > k, scale(k) * (
            F.cos(wave(k)) * (F.get("_cos", F.lit(k - 1)) * F.col("_copies"))
            + F.sin(wave(k)) * (F.get("_sin", F.lit(k - 1)) * F.col("_copies")))) for k in range(1, n_harmonics + 1)}})


# --- F6, F8, T5 -------------------------------------------------------------------------

def date_field_columns(date: str = "date") -> list[Column]:
    """F6 + F8: ``weekDay`` (Monday = 1), ``day`` of month, ``weekOfMonth``."""
    return [weekday_mon1(date).alias("weekDay"), month_day(date).alias("day"),
            week_of_month_calendar(date).alias("weekOfMonth")]


# Seeds of the two noise columns, per split.
NOISE_SEEDS = {"train": (22, 66), "test": (23, 67)}


def add_noise(df: DataFrame, keys=("itemID", "date")) -> DataFrame:
    """T5: ``random_noise1/2`` ~ N(0, 1) rounded to 2, seeded per split and keyed
    by (item, date), so the value of a row does not depend on partitioning.
    Both columns come from one md5 of (item, date, seed 1, seed 2)."""
    s1, s2 = F.lit(NOISE_SEEDS["train"][0]), F.lit(NOISE_SEEDS["train"][1])
    for split, (a, b) in NOISE_SEEDS.items():
        s1 = F.when(F.col("split") == split, F.lit(a)).otherwise(s1)
        s2 = F.when(F.col("split") == split, F.lit(b)).otherwise(s2)
    n1, n2 = gaussian_pair(*[F.col(k) for k in keys], s1, s2)
    return df.withColumn("random_noise1", round2(n1)).withColumn("random_noise2", round2(n2))


# --- P13, Q7 ----------------------------------------------------------------------------

QTY_LAG_COLUMNS = [f"qty_sold_lag{k}" for k in LAGS]


def drop_incomplete(df: DataFrame, cols=QTY_LAG_COLUMNS) -> DataFrame:
    """Drop rows with a NULL among the unit lags (the first days of a series)."""
    return df.dropna(subset=list(cols))


def retention(df: DataFrame, cols=QTY_LAG_COLUMNS, keys=("split",)) -> DataFrame:
    """Q7: rows kept by :func:`drop_incomplete`, as count and % (round 2)."""
    complete = F.lit(True)
    for c in cols:
        complete = complete & F.col(c).isNotNull()
    return df.groupBy(*keys).agg(
        F.count("*").alias("rows_before"),
        F.count_if(complete).alias("rows_kept"),
        round_half_even(F.count_if(complete) / F.count("*") * 100, 2).alias("kept_pct"))
