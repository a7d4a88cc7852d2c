"""Series operators named in the brief and the exploration notes.

Per-item windows over the dense grid, as in :mod:`tillcast.operators.features`.
The two recursive filters (Kalman, exponential smoothing) fold an item's
date-sorted series with the SQL ``aggregate`` function in blocks of about
sqrt(length) days: the series of one item is bounded by the calendar length,
the fold runs in the JVM, and the result is exploded back to one row per
(item, date).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.functions import is_nonzero
from tillcast.sources.fixtures import Calendar

ITEM = ["split", "itemID"]


def _ordered(keys=ITEM) -> Window:
    return Window.partitionBy(*keys).orderBy("date")


def demand_label(grid: DataFrame, horizon: int = 14, col: str = "qty_sold",
                 keys=ITEM) -> DataFrame:
    """``demand_next_{h}`` = units of the next ``horizon`` days; NULL if the
    series ends before the horizon is complete."""
    f = _ordered(keys).rowsBetween(1, horizon)
    return grid.withColumn(f"demand_next_{horizon}",
                           F.when(F.count(col).over(f) == horizon, F.sum(col).over(f))
                           .cast("long"))


def biweekly_assortment(daily: DataFrame, cal: Calendar, days: int = 14) -> DataFrame:
    """Per 14-day restocking period (counted from the first train day), the
    items sold in it; these are the items to keep in stock for that period."""
    bucket = F.floor(F.datediff("date", F.lit(cal.train_start).cast("date")) / days).cast("int")
    return (daily.where(F.col("qty_sold") > 0)
            .groupBy(bucket.alias("period"), "itemID")
            .agg(F.sum("qty_sold").cast("long").alias("units"),
                 F.count("*").alias("sale_days")))


def sparse_item_filter(grid: DataFrame, min_days: int, keys=ITEM) -> DataFrame:
    """Keep only items sold on at least ``min_days`` days of their split."""
    keep = (grid.groupBy(*keys).agg(F.count_if(is_nonzero("qty_sold")).alias("n"))
            .where(F.col("n") >= min_days).select(*keys))
    return grid.join(keep, list(keys), "left_semi")


def outlier_flags(grid: DataFrame, col: str = "qty_sold", z: float = 3.0, k: float = 1.5,
                  keys=ITEM) -> DataFrame:
    """Per item z-score flag (|z| > 3) and IQR flag (outside q1 - 1.5 IQR,
    q3 + 1.5 IQR), quartiles exact with linear interpolation."""
    w = Window.partitionBy(*keys)
    x = F.col(col).cast("double")
    g = (grid.withColumn("_m", F.avg(x).over(w)).withColumn("_s", F.stddev_samp(x).over(w))
         .withColumn("_q1", F.percentile(x, 0.25).over(w))
         .withColumn("_q3", F.percentile(x, 0.75).over(w)))
    zs = (x - F.col("_m")) / F.col("_s")
    iqr = F.col("_q3") - F.col("_q1")
    return (g.withColumn("z_score", F.when(F.col("_s") > 0, zs))
            .withColumn("z_outlier", F.coalesce(F.abs(F.col("z_score")) > z, F.lit(False)))
            .withColumn("iqr_outlier", (x < F.col("_q1") - k * iqr) | (x > F.col("_q3") + k * iqr))
            .drop("_m", "_s", "_q1", "_q3"))


def normalise(grid: DataFrame, col: str = "qty_sold", keys=ITEM) -> DataFrame:
    """Per item z-normalised and min-max scaled values (NULL when constant)."""
    w = Window.partitionBy(*keys)
    x = F.col(col).cast("double")
    mn, mx = F.min(x).over(w), F.max(x).over(w)
    sd = F.stddev_samp(x).over(w)
    return (grid.withColumn(f"{col}_z", F.when(sd > 0, (x - F.avg(x).over(w)) / sd))
            .withColumn(f"{col}_minmax", F.when(mx > mn, (x - mn) / (mx - mn))))


def _series(grid: DataFrame, col: str, keys) -> DataFrame:
    """One row per item with its date-sorted days ``_s``, an array of (date, x)."""
    return grid.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("date", F.col(col).cast("double").alias("x")))).alias("_s"))


def _folded(s: Column, first_state: Column, step, state_ddl: str, row, row_ddl: str) -> Column:
    """Folds an array of days; ``step(state, day)`` returns the new state struct (DDL ``state_ddl``), of which
    ``row(state, day)`` makes the day's result (DDL ``row_ddl``). Returns the array of results.

    Appending one output per step would copy the growing array every time
    (quadratic in the series length L). Instead the series is cut into blocks of
    about sqrt(L) days: a first fold over the blocks carries only the state and
    records the state at each block start; then every block replays its own
    days from that state. Copies are O(L sqrt(L)), with the same step function,
    so the same results.
    """
    n = F.size(s)
    size = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
    n_blocks = F.ceil(n / size).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), n_blocks - 1),
                         lambda b: F.slice(s, b * size + 1, size))

    def run_block(st, blk):
        return F.aggregate(blk, st, step)

    no_states = F.array().cast(f"array<{state_ddl}>")
    starts = F.aggregate(
        blocks, F.struct(no_states.alias("starts"), first_state.alias("st")),
        lambda acc, blk: F.struct(
            F.concat(acc.getField("starts"), F.array(acc.getField("st"))).alias("starts"),
            run_block(acc.getField("st"), blk).alias("st"))).getField("starts")
    no_out = F.array().cast(f"array<{row_ddl}>")

    def replay(blk, st0):
        def merge(acc, e):
            st = step(acc.getField("st"), e)
            return F.struct(F.concat(acc.getField("out"), F.array(row(st, e))).alias("out"), st.alias("st"))
        return F.aggregate(blk, F.struct(no_out.alias("out"), st0.alias("st")),
                           merge).getField("out")

    return F.flatten(F.zip_with(blocks, starts, replay))


def _fold_series(grid: DataFrame, col: str, init, step, out: str, state_ddl: str,
                 keys=ITEM) -> DataFrame:
    """Fold each item's date-sorted series; ``step(state, x)`` returns the new state
    struct whose field ``v`` is the output for that day."""
    series = _series(grid, col, keys)
    s = F.col("_s")
    outputs = _folded(s, init(F.element_at(s, 1).getField("x")), lambda st, e: step(st, e.getField("x")), state_ddl,
                      lambda st, e: F.struct(e.getField("date").alias("date"), st.getField("v").alias("v")),
                      "struct<date:date,v:double>")
    return series.select(*keys, F.inline(outputs)).withColumnRenamed("v", out)


def exponential_smoothing(grid: DataFrame, alpha: float = 0.3, col: str = "qty_sold",
                          keys=ITEM) -> DataFrame:
    """``s_0 = x_0``, ``s_t = alpha * x_t + (1 - alpha) * s_{t-1}`` per item."""
    a = F.lit(float(alpha))

    def init(x0):
        return F.struct(x0.alias("v"))

    def step(st, x):
        return F.struct((a * x + (F.lit(1.0) - a) * st.getField("v")).alias("v"))

    # the first step re-applies x0 to s = x0, which leaves it unchanged
    return _fold_series(grid, col, init, step, "smoothed", "struct<v:double>", keys)


#: Smoothing parameters that a series' own is chosen from.
ALPHAS = (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9)


def fitted_smoothing(grid: DataFrame, col: str = "qty_sold", keys=ITEM, alphas=ALPHAS) -> DataFrame:
    """T12 with a parameter of the item's own: the one of ``alphas`` whose level predicts the next day best.

    One fold carries the level under every alpha and the sum of its squared one-day-ahead errors; the alpha
    with the least sum (the first, if equal) is the item's. A second fold smooths with it.
    Output: ``alpha``, its ``squared_error``, ``smoothed`` (the level after the day) and ``ahead`` (the level
    before it, that is the day's forecast; the first day's is its own value). A missing value costs nothing
    and leaves the level; before the first value the level is NULL.
    """
    series = _series(grid, col, keys).withColumn("_grid", F.array(*[F.lit(float(a)) for a in alphas]))
    s = F.col("_s")

    def after(v: Column, a: Column, x: Column) -> tuple[Column, Column, Column]:
        """Level after the day, level before it, and its error."""
        ahead = F.coalesce(v, x)
        now = F.coalesce(x, ahead)
        return a * now + (F.lit(1.0) - a) * ahead, ahead, F.coalesce(now - ahead, F.lit(0.0))

    def errors(states: Column, e: Column) -> Column:
        def one(st, a):
            v, _, miss = after(st.getField("v"), a, e.getField("x"))
            return F.struct(v.alias("v"), (st.getField("e") + miss * miss).alias("e"))
        return F.zip_with(states, F.col("_grid"), one)

    nothing = F.lit(None).cast("double")
    start = F.transform("_grid", lambda a: F.struct(nothing.alias("v"), F.lit(0.0).alias("e")))
    series = series.withColumn("_e", F.transform(F.aggregate(s, start, errors), lambda st: st.getField("e")))
    series = series.withColumn("_a", F.element_at("_grid", F.array_position("_e", F.array_min("_e")).cast("int")))
    a = F.col("_a")

    def step(st: Column, e: Column) -> Column:
        v, ahead, _ = after(st.getField("v"), a, e.getField("x"))
        return F.struct(v.alias("v"), ahead.alias("ahead"))

    rows = _folded(s, F.struct(nothing.alias("v"), nothing.alias("ahead")), step, "struct<v:double,ahead:double>",
                   lambda st, e: F.struct(e.getField("date").alias("date"), st.getField("v").alias("v"), st.getField("ahead").alias("ahead")),
                   "struct<date:date,v:double,ahead:double>")
    return series.select(*keys, a.alias("alpha"), F.array_min("_e").alias("squared_error"), F.inline(rows)).withColumnRenamed("v", "smoothed")


def kalman_smoothing(grid: DataFrame, q: float = 1.0, r: float = 10.0, col: str = "qty_sold",
                     keys=ITEM) -> DataFrame:
    """Local-level Kalman filter per item (process variance ``q``,
    measurement variance ``r``); the estimate starts at the first value with
    variance ``r``. Output ``kalman`` is the filtered level of each day."""
    qv, rv = F.lit(float(q)), F.lit(float(r))

    def init(x0):
        # the first step processes x0 itself from the prior (x0, r - q): its
        # predicted variance is r, and the level stays x0 since x0 - v = 0
        return F.struct(x0.alias("v"), (rv - qv).alias("p"))

    def step(st, x):
        p_pred = st.getField("p") + qv
        gain = p_pred / (p_pred + rv)
        v = st.getField("v") + gain * (x - st.getField("v"))
        return F.struct(v.alias("v"), ((F.lit(1.0) - gain) * p_pred).alias("p"))

    return _fold_series(grid, col, init, step, "kalman", "struct<v:double,p:double>", keys)


#: Process and measurement variances that a series' own are chosen from.
VARIANCES = [(q, r) for q in (0.01, 0.1, 1.0) for r in (1.0, 10.0, 100.0)]


def kalman_smoother(grid: DataFrame, col: str = "qty_sold", keys=ITEM, variances=VARIANCES) -> DataFrame:
    """T11, both passes: the level of every day given the whole series, with variances of the item's own.

    One fold carries a filter for every pair (q, r) of ``variances`` and the log-likelihood of the series
    under it; the likeliest pair (the first, if equal) is the item's. A second fold filters with
    it and keeps each day's level v and variance p; a third goes backwards over these:
    ``s_t = v_t + p_t / (p_t + q) * (s_{t+1} - v_t)``, starting at the last day's level. As in
    :func:`kalman_smoothing`, the level starts at the first value with variance r.
    """
    series = _series(grid, col, keys).withColumn("_grid", F.array(*[
        F.struct(F.lit(float(q)).alias("q"), F.lit(float(r)).alias("r")) for q, r in variances]))
    s, first = F.col("_s"), F.element_at("_s", 1).getField("x")

    def filtered(v: Column, p: Column, q: Column, r: Column, x: Column) -> tuple[Column, Column, Column]:
        """Level, variance and predicted variance after a day."""
        ahead = p + q
        gain = ahead / (ahead + r)
        return v + gain * (x - v), (F.lit(1.0) - gain) * ahead, ahead

    def likelier(states: Column, e: Column) -> Column:
        def one(st, c):
            v, p, ahead = filtered(st.getField("v"), st.getField("p"), c.getField("q"), c.getField("r"), e.getField("x"))
            miss, spread = e.getField("x") - st.getField("v"), ahead + c.getField("r")
            return F.struct(v.alias("v"), p.alias("p"), (st.getField("l") - F.lit(0.5) * (F.log(spread) + miss * miss / spread)).alias("l"))
        return F.zip_with(states, F.col("_grid"), one)

    start = F.transform("_grid", lambda c: F.struct(first.alias("v"), (c.getField("r") - c.getField("q")).alias("p"), F.lit(0.0).alias("l")))
    found = F.transform(F.aggregate(s, start, likelier), lambda st: st.getField("l"))
    series = series.withColumn("_l", found).withColumn("_c", F.element_at("_grid", F.array_position("_l", F.array_max("_l")).cast("int")))
    q, r = F.col("_c").getField("q"), F.col("_c").getField("r")

    def forward(st: Column, e: Column) -> Column:
        v, p, _ = filtered(st.getField("v"), st.getField("p"), q, r, e.getField("x"))
        return F.struct(v.alias("v"), p.alias("p"))

    day = "struct<date:date,v:double,p:double>"
    series = series.withColumn("_f", _folded(
        s, F.struct(first.alias("v"), (r - q).alias("p")), forward, "struct<v:double,p:double>",
        lambda st, e: F.struct(e.getField("date").alias("date"), st.getField("v").alias("v"), st.getField("p").alias("p")), day))

    def backward(st: Column, e: Column) -> Column:
        v, p = e.getField("v"), e.getField("p")
        return F.struct((v + p / (p + q) * (st.getField("s") - v)).alias("s"))

    last = F.struct(F.element_at("_f", -1).getField("v").alias("s"))  # the last day's step from itself leaves it there
    rows = _folded(F.reverse("_f"), last, backward, "struct<s:double>",
                   lambda st, e: F.struct(e.getField("date").alias("date"), e.getField("v").alias("v"), st.getField("s").alias("s")),
                   "struct<date:date,v:double,s:double>")
    return series.select(*keys, q.alias("q"), r.alias("r"), F.inline(rows)).withColumnsRenamed({"v": "kalman", "s": "smoothed"})
