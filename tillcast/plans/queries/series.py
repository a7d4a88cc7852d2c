"""Series operators: labels, assortment, filters, outliers, smoothing."""

from __future__ import annotations

from tillcast.operators import features as X
from tillcast.operators import series as S
from tillcast.plans import features as E1
from tillcast.plans import oracle as O
from tillcast.plans.registry import register
from tillcast.plans.queries.common import (
    DC, GRID_CTES, _every, _grid)


# --- series (T4, T6-T12, W10) ---------------------------------------------------------------

@register("demand_label", O.with_(*GRID_CTES) + """SELECT split, itemID, date, qty_sold,
  CASE WHEN count(qty_sold) OVER f = 14 THEN CAST(sum(qty_sold) OVER f AS BIGINT) END AS demand_next_14
FROM grid WINDOW f AS (PARTITION BY split, itemID ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 14 FOLLOWING)""",
          ops=("T6",))
def q_demand_label(spark, sf):
    """Units of the next 14 days per (item, day); NULL where the horizon is incomplete."""
    return S.demand_label(_grid(spark, sf)).select("split", "itemID", "date", "qty_sold",
                                                    "demand_next_14")


@register("biweekly_assortment", O.with_(*O.pipeline_ctes(O.LINEITEM_ALL, "daily")) + f"""SELECT
  CAST(floor(date_diff('day', {O.d(DC.train_start)}, date) / 14) AS INT) AS period, itemID,
  CAST(sum(qty_sold) AS BIGINT) AS units, count(*) AS sale_days
FROM daily WHERE qty_sold > 0 GROUP BY 1, 2""", ops=("T7",))
def q_biweekly_assortment(spark, sf):
    """Items sold in each 14-day restocking period."""
    return S.biweekly_assortment(E1.daily_table(_every(spark, sf), DC), DC)


@register("sparse_item_filter", O.with_(*GRID_CTES) + """SELECT split, itemID, date, qty_sold FROM grid
WHERE (split, itemID) IN (SELECT split, itemID FROM grid GROUP BY split, itemID
                          HAVING count(*) FILTER (WHERE qty_sold IS DISTINCT FROM 0) >= 3)""",
          ops=("T8",))
def q_sparse_item_filter(spark, sf):
    """Grid rows of items sold on at least 3 days of their split."""
    return S.sparse_item_filter(_grid(spark, sf), 3).select("split", "itemID", "date", "qty_sold")


@register("outlier_flags", O.with_(*GRID_CTES) + """SELECT split, itemID, date, qty_sold,
  CASE WHEN stddev_samp(qty_sold) OVER w > 0
       THEN (qty_sold - avg(qty_sold) OVER w) / stddev_samp(qty_sold) OVER w END AS z_score,
  coalesce(abs(CASE WHEN stddev_samp(qty_sold) OVER w > 0
       THEN (qty_sold - avg(qty_sold) OVER w) / stddev_samp(qty_sold) OVER w END) > 3, false) AS z_outlier,
  (qty_sold < quantile_cont(qty_sold, 0.25) OVER w
     - 1.5 * (quantile_cont(qty_sold, 0.75) OVER w - quantile_cont(qty_sold, 0.25) OVER w))
  OR (qty_sold > quantile_cont(qty_sold, 0.75) OVER w
     + 1.5 * (quantile_cont(qty_sold, 0.75) OVER w - quantile_cont(qty_sold, 0.25) OVER w)) AS iqr_outlier
FROM grid WINDOW w AS (PARTITION BY split, itemID)""", fuzz=("z_score",), ops=("T9",))
def q_outlier_flags(spark, sf):
    """Per item z-score and IQR outlier flags of daily units."""
    return S.outlier_flags(_grid(spark, sf)).select("split", "itemID", "date", "qty_sold",
                                                     "z_score", "z_outlier", "iqr_outlier")


@register("normalised_units", O.with_(*GRID_CTES) + """SELECT split, itemID, date, qty_sold,
  CASE WHEN stddev_samp(qty_sold) OVER w > 0
       THEN (qty_sold - avg(qty_sold) OVER w) / stddev_samp(qty_sold) OVER w END AS qty_sold_z,
  CASE WHEN max(qty_sold) OVER w > min(qty_sold) OVER w
       THEN (qty_sold - min(qty_sold) OVER w) / (max(qty_sold) OVER w - min(qty_sold) OVER w) END AS qty_sold_minmax
FROM grid WINDOW w AS (PARTITION BY split, itemID)""", fuzz=("qty_sold_z", "qty_sold_minmax"),
          ops=("T10",))
def q_normalised_units(spark, sf):
    """Per item z-normalised and min-max scaled daily units."""
    return S.normalise(_grid(spark, sf)).select("split", "itemID", "date", "qty_sold",
                                                 "qty_sold_z", "qty_sold_minmax")


_SMOOTH = " + ".join(O.harmonic_sql(k) for k in range(1, 11))


@register("harmonic_smoothing", O.with_(*GRID_CTES, """gt AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY split, itemID ORDER BY date) - 1 AS DOUBLE) AS t,
         CAST(count(*) OVER (PARTITION BY split, itemID) AS DOUBLE) AS L FROM grid)""")
          + f"""SELECT split, itemID, date, qty_sold, ({_SMOOTH}) + avg(qty_sold) OVER wi AS harmonic_smooth
FROM gt WINDOW wi AS (PARTITION BY split, itemID)""", fuzz=("harmonic_smooth",), ops=("T4", "T3"))
def q_harmonic_smoothing(spark, sf):
    """Series mean plus its first 10 Fourier components."""
    return X.harmonic_smoothing(_grid(spark, sf).select("split", "itemID", "date", "qty_sold"), "qty_sold", 10)


@register("rolling_median_distinct", O.with_(*GRID_CTES) + """SELECT split, itemID, date, qty_sold,
  CASE WHEN count(qty_sold) OVER r = 7
       THEN CAST(list_aggregate(list_distinct(list(qty_sold) OVER r), 'median') AS DOUBLE) END
    AS rolling_median_distinct
FROM grid WINDOW r AS (PARTITION BY split, itemID ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""",
          ops=("W10",))
def q_rolling_median_distinct(spark, sf):
    """Median of the distinct values among the previous 7 days' units."""
    return _grid(spark, sf).select("split", "itemID", "date", "qty_sold",
                                   X.rolling_median_distinct("qty_sold", 7)
                                   .alias("rolling_median_distinct"))


def _fold_sql(init_cols: str, step_cols: str, state: str, out: str) -> str:
    """DuckDB recursive CTE walking each item's series day by day."""
    return O.with_(*GRID_CTES, """gn AS (
  SELECT split, itemID, date, CAST(qty_sold AS DOUBLE) AS x,
         row_number() OVER (PARTITION BY split, itemID ORDER BY date) AS rn FROM grid)""") \
        + f"""SELECT split, itemID, date, v AS {out} FROM (
  WITH RECURSIVE fold(split, itemID, rn, date, {state}) AS (
    SELECT split, itemID, rn, date, {init_cols} FROM gn WHERE rn = 1
    UNION ALL
    SELECT g.split, g.itemID, g.rn, g.date, {step_cols}
    FROM fold f JOIN gn g ON g.split = f.split AND g.itemID = f.itemID AND g.rn = f.rn + 1)
  SELECT * FROM fold)"""


_A = O.dbl(0.3)


_ONE = O.dbl(1.0)


@register("exponential_smoothing",
          _fold_sql("x", f"{_A} * g.x + ({_ONE} - {_A}) * f.v", "v", "smoothed"),
          fuzz=("smoothed",), ops=("T12",))
def q_exponential_smoothing(spark, sf):
    """Exponentially smoothed daily units per item (alpha 0.3)."""
    return S.exponential_smoothing(_grid(spark, sf), 0.3)


def _fitted_sql() -> str:
    """Smoothing with every alpha, its summed squared errors, and the rows of the best one."""
    grid = ", ".join(f"({k}, {O.dbl(a)})" for k, a in enumerate(S.ALPHAS))
    miss = "(g.x - f.v)"
    return O.with_(*GRID_CTES, """gn AS (
  SELECT split, itemID, date, CAST(qty_sold AS DOUBLE) AS x, row_number() OVER (PARTITION BY split, itemID ORDER BY date) AS rn FROM grid)""") \
        + f"""SELECT split, itemID, alpha, squared_error, date, v AS smoothed, ahead FROM (
  WITH RECURSIVE alphas(k, alpha) AS (VALUES {grid}),
  fold(k, alpha, split, itemID, rn, date, v, ahead, e) AS (
    SELECT k, alpha, split, itemID, rn, date, alpha * x + ({_ONE} - alpha) * x, x, {O.dbl(0.0)} FROM gn, alphas WHERE rn = 1
    UNION ALL
    SELECT f.k, f.alpha, g.split, g.itemID, g.rn, g.date, f.alpha * g.x + ({_ONE} - f.alpha) * f.v, f.v, f.e + {miss} * {miss}
    FROM fold f JOIN gn g ON g.split = f.split AND g.itemID = f.itemID AND g.rn = f.rn + 1),
  kept AS (
    SELECT *, first_value(k) OVER last AS best, first_value(e) OVER last AS squared_error
    FROM fold WINDOW last AS (PARTITION BY split, itemID ORDER BY rn DESC, e, k))
  SELECT * FROM kept WHERE k = best)"""


@register("fitted_smoothing", _fitted_sql(), fuzz=("squared_error", "smoothed", "ahead"), ops=("T12",))
def q_fitted_smoothing(spark, sf):
    """Exponentially smoothed daily units, the parameter of every item chosen by its one-day-ahead errors."""
    return S.fitted_smoothing(_grid(spark, sf))


_Q, _R = O.dbl(1.0), O.dbl(10.0)


_PP = f"(f.p + {_Q})"


_K = f"({_PP} / ({_PP} + {_R}))"


_PP0 = f"(({_R} - {_Q}) + {_Q})"          # first step starts from P = r - q


_K0 = f"({_PP0} / ({_PP0} + {_R}))"


@register("kalman_smoothing",
          _fold_sql(f"x + {_K0} * (x - x), ({_ONE} - {_K0}) * {_PP0}",
                    f"f.v + {_K} * (g.x - f.v), ({_ONE} - {_K}) * {_PP}", "v, p", "kalman"),
          fuzz=("kalman",), ops=("T11",))
def q_kalman_smoothing(spark, sf):
    """Local-level Kalman filter of daily units per item (q 1, r 10)."""
    return S.kalman_smoothing(_grid(spark, sf), 1.0, 10.0)


def _smoother_sql() -> str:
    """Filters of every (q, r), the likeliest, its days again with their variances, and the walk back."""
    grid = ", ".join(f"({k}, {O.dbl(q)}, {O.dbl(r)})" for k, (q, r) in enumerate(S.VARIANCES))
    pp, half, one = "(f.p + f.q)", O.dbl(0.5), O.dbl(1.0)
    gain = f"({pp} / ({pp} + f.r))"
    p0 = "((r - q) + q)"
    g0 = f"({p0} / ({p0} + r))"
    return O.with_(*GRID_CTES, """gn AS (
  SELECT split, itemID, date, CAST(qty_sold AS DOUBLE) AS x, row_number() OVER (PARTITION BY split, itemID ORDER BY date) AS rn FROM grid)""") \
        + f"""SELECT split, itemID, date, q, r, v AS kalman, s AS smoothed FROM (
  WITH RECURSIVE variances(k, q, r) AS (VALUES {grid}),
  fold(k, q, r, split, itemID, rn, date, v, p, l) AS (
    SELECT k, q, r, split, itemID, rn, date, x + {g0} * (x - x), ({one} - {g0}) * {p0}, {O.dbl(0.0)} - {half} * (ln({p0} + r) + 0 / ({p0} + r))
    FROM gn, variances WHERE rn = 1
    UNION ALL
    SELECT f.k, f.q, f.r, g.split, g.itemID, g.rn, g.date, f.v + {gain} * (g.x - f.v), ({one} - {gain}) * {pp},
           f.l - {half} * (ln({pp} + f.r) + (g.x - f.v) * (g.x - f.v) / ({pp} + f.r))
    FROM fold f JOIN gn g ON g.split = f.split AND g.itemID = f.itemID AND g.rn = f.rn + 1),
  kept AS (
    SELECT *, first_value(k) OVER (PARTITION BY split, itemID ORDER BY rn DESC, l DESC, k) AS best,
           max(rn) OVER (PARTITION BY split, itemID) AS n FROM fold),
  chosen AS (SELECT * FROM kept WHERE k = best),
  back(split, itemID, rn, date, q, r, v, s) AS (
    SELECT split, itemID, rn, date, q, r, v, v FROM chosen WHERE rn = n
    UNION ALL
    SELECT c.split, c.itemID, c.rn, c.date, c.q, c.r, c.v, c.v + c.p / (c.p + c.q) * (b.s - c.v)
    FROM back b JOIN chosen c ON c.split = b.split AND c.itemID = b.itemID AND c.rn = b.rn - 1)
  SELECT * FROM back)"""


@register("kalman_smoother", _smoother_sql(), fuzz=("kalman", "smoothed"), ops=("T11",))
def q_kalman_smoother(spark, sf):
    """Level of daily units given the whole series (filter and backward pass), with variances per item chosen
    by likelihood."""
    return S.kalman_smoother(_grid(spark, sf))
