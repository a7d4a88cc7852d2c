"""Models: scores, importance, ensemble forecast, category encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillcast.operators import boosting as T
from tillcast.operators import categories as C
from tillcast.operators import inventory as B
from tillcast.operators import model as M
from tillcast.plans import features as E1
from tillcast.plans import oracle as O
from tillcast.plans.registry import register
from tillcast.schemas import MODEL_FEATURES
from tillcast.session import written
from tillcast.sources import fixtures as FX
from tillcast.plans.queries.common import (
    EC, LC, _ev, _shared_dir)


# --- models (M1-M11) ---------------------------------------------------------------------------

def _ev_features(spark, sf, keep: bool = True):
    """Model input over the events fixture; ``keep`` writes the feature
    table to the shared folder and trains from the written copy (cut lineage,
    one computation for several fits)."""
    return M.prepare_features(_ev_table(spark, sf, keep))


def _ev_table(spark, sf, keep: bool = True, drop_incomplete: bool = True):
    ft = E1.feature_table(_ev(spark, sf), FX.event_items(spark, sf), EC, drop_incomplete=drop_incomplete)
    return written(ft) if keep else ft


@register("score_lag7_predictor", O.with_(*O.pipeline_ctes(O.EVENTS, "feat")) + """SELECT split, count(*) AS n,
  avg(CAST(CAST(qty_sold_lag7 AS DOUBLE) = CAST(qty_sold AS DOUBLE) AS DOUBLE)) AS accuracy,
  1 - sum((qty_sold - qty_sold_lag7) * (qty_sold - qty_sold_lag7)) / nullif(sum(CAST(qty_sold AS DOUBLE) * qty_sold) - count(*) * avg(qty_sold) * avg(qty_sold), 0) AS r2
FROM feat GROUP BY split""", fuzz=("accuracy", "r2"), ops=("M5", "M6"))
def q_score_lag7_predictor(spark, sf):
    """Exact-match accuracy and R2 of the same-weekday-last-week predictor."""
    ft = _ev_features(spark, sf, keep=False).withColumn("lag7", F.col("qty_sold_lag7").cast("double"))
    return M.scores(ft, "lag7", keys=["split"])


def _gbt(spark, sf):
    ft = _ev_features(spark, sf)
    train, test = ft.where(F.col("split") == "train"), ft.where(F.col("split") == "test")
    return M.fit_gbt(train), test


@register("model_gbt_scores", None, ops=("M1", "M2", "M3", "M4", "M5", "M6"))
def q_model_gbt_scores(spark, sf):
    """Boosted trees (depth 5, rate 0.1, 50 rounds): accuracy and R2 of rounded test predictions."""
    model, test = _gbt(spark, sf)
    return M.scores(M.predict(model, test, rounded=True))


@register("model_rf_scores", None, ops=("M1", "M2", "M8", "M6"))
def q_model_rf_scores(spark, sf):
    """Random forest (depth 5, 100 trees): accuracy and R2 of raw test predictions."""
    ft = _ev_features(spark, sf)
    model = M.fit_forest(ft.where(F.col("split") == "train"))
    return M.scores(M.predict(model, ft.where(F.col("split") == "test"), rounded=False))


@register("model_importance", None, ops=("M7", "M9"))
def q_model_importance(spark, sf):
    """Feature importance of the boosted trees, with the features ranked above both noise columns."""
    model, _ = _gbt(spark, sf)
    imp = M.feature_importance(model, spark)
    above = M.above_noise(imp).select("feature", F.lit(True).alias("above_noise"))
    return imp.join(above, "feature", "left").fillna({"above_noise": False})


@register("model_ensemble_forecast", None, ops=("M10", "M11", "S6", "B1"))
def q_model_ensemble_forecast(spark, sf):
    """Mean of boosted-tree and forest predictions on test days, summed per item as an
    integer forecast, valued against the actual units of those days."""
    ft = _ev_features(spark, sf)
    train, test = ft.where(F.col("split") == "train"), ft.where(F.col("split") == "test")
    pg = M.predict(M.fit_gbt(train), test, rounded=False)
    pr = M.predict(M.fit_forest(train), test, rounded=False)
    fc = M.item_forecast(M.ensemble([pg, pr]))
    actual = test.groupBy("itemID").agg(F.sum("qty_sold").cast("long").alias("actual"))
    si = B.score_input(FX.event_items(spark, sf), fc.withColumnRenamed(
        "demandPrediction", "forecast"), actual, FX.event_infos(spark, sf))
    return B.monetary_value(si)




@register("forecast_14_days", None, ops=("M11", "F13", "S6"))
def q_forecast_14_days(spark, sf):
    """The forecast of the brief on the events fixture: units of every item in the 14 days from the
    forecast start, with the promotion dates of infos as input."""
    from tillcast.plans import modelling as E2
    items = FX.event_items(spark, sf)
    path = _shared_dir(spark, "horizon")
    E2.horizon_table(_ev(spark, sf), items, FX.event_infos(spark, sf), EC).write.parquet(path)
    return E2.forecast_all_items(spark.read.schema(E2.horizon_schema(items)).parquet(path), EC)


_HORIZON_COLS = ["itemID", "date", "demand", "promo_days", "qty_sold_lag1", "cum_sum_order", "PriceToday", "weekDay"]


@register("forecast_inputs", O.with_(*O.pipeline_ctes(O.WHOLE_SERIES, "feat", drop_incomplete=False), f"""hz AS (
  SELECT *, CASE WHEN count(*) OVER a = {LC.horizon} THEN CAST(sum(qty_sold) OVER a AS BIGINT) END AS demand,
         CASE WHEN count(*) OVER a = {LC.horizon} THEN CAST(sum(promotion) OVER a AS BIGINT) END AS pd
  FROM feat WINDOW a AS (PARTITION BY itemID ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {LC.horizon} FOLLOWING)),
pl AS (SELECT itemID, simulationPrice, len(list_filter(list_transform(string_split(promotion, ','), lambda x: CAST(trim(x) AS DATE)),
         lambda d: d BETWEEN {O.d(LC.forecast_start)} AND {O.d(LC.forecast_end)})) AS n FROM infos_v)""") + f"""
SELECT itemID, date, demand, pd AS promo_days, qty_sold_lag1, cum_sum_order, PriceToday, weekDay FROM hz WHERE demand IS NOT NULL
UNION ALL
SELECT i.itemID, {O.d(LC.test_end)}, NULL, CAST(coalesce(pl.n, 0) AS BIGINT), h.qty_sold_lag1, h.cum_sum_order,
  coalesce(h.PriceToday, pl.simulationPrice), CAST(isodow({O.d(LC.test_end)}) AS INT)
FROM items_v i LEFT JOIN (SELECT * FROM hz WHERE date = {O.d(LC.test_end)}) h ON i.itemID = h.itemID
LEFT JOIN pl ON pl.itemID = i.itemID""", ops=("M11", "T6", "F13"))
def q_forecast_inputs(spark, sf):
    """Inputs of the 14-day forecast: known horizons of the history, and a row of every item at the origin."""
    from tillcast.plans import modelling as E2
    kinds = FX.transaction_kinds(spark, sf, LC)
    return E2.horizon_table(kinds, FX.items(spark, sf), FX.infos(spark, sf), LC).select(*_HORIZON_COLS)


@register("ensemble_of_lags", O.with_(*O.pipeline_ctes(O.EVENTS, "feat")) + """SELECT split, itemID, date,
  (CAST(qty_sold_lag7 AS DOUBLE) + rolling_qty_sold_mean) / 2 AS prediction FROM feat""",
          fuzz=("prediction",), ops=("M10",))
def q_ensemble_of_lags(spark, sf):
    """Mean of two fixed predictors (same weekday last week; mean of the last 7 days) per row."""
    ft = _ev_features(spark, sf, keep=False)
    two = [ft.select("split", "itemID", "date", F.col(c).cast("double").alias("prediction"))
           for c in ("qty_sold_lag7", "rolling_qty_sold_mean")]
    return M.ensemble(two, keys=("split", "itemID", "date"))


# --- category encoding (M1) ----------------------------------------------------------------

_CATS = ["promotion", "brand", "manufacturer", "category1", "category2", "category3"]


@register("category_encoding", O.with_(*O.pipeline_ctes(O.EVENTS, "feat")) + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", v AS value, CAST(row_number() OVER (ORDER BY n DESC, v) - 1 AS INT) AS index
FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM feat WHERE split = 'train' AND {c} IS NOT NULL GROUP BY 1)"""
    for c in _CATS), ops=("M1",))
def q_category_encoding(spark, sf):
    """Index of every categorical value as fitted on the train features
    (most frequent = 0, ties alphabetical)."""
    return C.category_encoding(_ev_table(spark, sf).where(F.col("split") == "train"), _CATS)


@register("category_order", O.with_(*O.pipeline_ctes(O.EVENTS, "feat")) + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", v AS value, n, label_mean, row_number() OVER (ORDER BY label_mean, v) - 1 AS position
FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n, {O.xavg('qty_sold')} AS label_mean FROM feat
      WHERE split = 'train' AND {c} IS NOT NULL GROUP BY 1)""" for c in _CATS), fuzz=("label_mean",), ops=("M1",))
def q_category_order(spark, sf):
    """Position of every categorical value in the order of the mean units of its train rows, which the tree
    models take as a number."""
    return C.category_order(_ev_table(spark, sf).where(F.col("split") == "train"), _CATS, "qty_sold")


# --- second-order boosting (M3) --------------------------------------------------------------

#: Features of few values in the fixture (a cut may lie at any of them); lags are NULL on the first days.
_TREE_FEATURES = ["qty_sold_lag1", "qty_sold_lag2", "qty_sold_lag7", "promotion", "medianDiscPerc", "weekDay", "day", "customerRating"]
_TREE_DEPTH = 3


def _tree_sql() -> list[str]:
    """CTEs that grow one tree level by level: ``grown`` has a row per (item, day) with its node, ``cut`` the cuts."""
    def value(x: str) -> str:
        return f"CAST({x} AS DOUBLE)"
    ctes = [*O.pipeline_ctes(O.EVENTS, "feat", drop_incomplete=False), f"""start AS (
  SELECT round_even(avg(qty_sold) * 1000000.0, 0) / 1000000.0 AS base FROM feat WHERE split = 'train'),
rows0 AS (
  SELECT split, itemID, date, 1 AS node, CAST(round_even((base - qty_sold) * 1000000.0, 0) AS BIGINT) AS g,
         [{', '.join(map(value, _TREE_FEATURES))}] AS x FROM feat, start)"""]
    term = "(({g} / 1000000.0) * ({g} / 1000000.0) / ({h} + 1.0))"
    gain = f"({term.format(g='gl', h='hl')} + {term.format(g='gr', h='hr')} - {term.format(g='ga', h='ha')}) * 0.5"
    for k in range(_TREE_DEPTH):
        ctes.append(f"""hist{k} AS (
  SELECT node, f, v, CAST(sum(g) AS BIGINT) AS g, count(*) AS h FROM (
    SELECT node, g, unnest(range({len(_TREE_FEATURES)})) AS f, unnest(x) AS v FROM rows{k} WHERE split = 'train' AND node >= {1 << k})
  GROUP BY node, f, v),
run{k} AS (
  SELECT node, f, v, sum(g) FILTER (v IS NOT NULL) OVER up AS lg, sum(h) FILTER (v IS NOT NULL) OVER up AS lh,
         coalesce(sum(g) FILTER (v IS NULL) OVER all_v, 0) AS ng, coalesce(sum(h) FILTER (v IS NULL) OVER all_v, 0) AS nh,
         sum(g) OVER all_v AS ga, sum(h) OVER all_v AS ha
  FROM hist{k} WINDOW all_v AS (PARTITION BY node, f),
       up AS (PARTITION BY node, f ORDER BY v NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
side{k} AS (
  SELECT node, f, v, ga, ha, ml, CAST(lg + CASE WHEN ml THEN ng ELSE 0 END AS BIGINT) AS gl, CAST(lh + CASE WHEN ml THEN nh ELSE 0 END AS BIGINT) AS hl
  FROM run{k}, (SELECT unnest([false, true]) AS ml) WHERE v IS NOT NULL),
gain{k} AS (
  SELECT node, f, v, ml, hl, hr, gl, gr, {gain} AS gain FROM (SELECT *, CAST(ga - gl AS BIGINT) AS gr, CAST(ha - hl AS BIGINT) AS hr FROM side{k}) s),
best{k} AS (
  SELECT * FROM gain{k} WHERE hl >= 1 AND hr >= 1 AND gain > 0
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, v, ml) = 1),
rows{k + 1} AS (
  SELECT r.split, r.itemID, r.date, r.g, r.x, CASE WHEN b.node IS NULL THEN r.node ELSE 2 * r.node + CASE
    WHEN r.x[b.f + 1] IS NULL THEN CASE WHEN b.ml THEN 0 ELSE 1 END WHEN r.x[b.f + 1] <= b.v THEN 0 ELSE 1 END END AS node
  FROM rows{k} r LEFT JOIN best{k} b ON b.node = r.node)""")
    names = ", ".join(f"'{f}'" for f in _TREE_FEATURES)
    ctes.append(f"""cut AS ({' UNION ALL '.join(f"SELECT node, [{names}][f + 1] AS feature, v AS threshold, ml AS missing_left, gain, hl + hr AS n FROM best{k}" for k in range(_TREE_DEPTH))}),
leaf AS (
  SELECT node, count(*) AS n, 0.1 * (-(CAST(sum(g) AS BIGINT) / 1000000.0) / (count(*) + 1.0)) AS value
  FROM rows{_TREE_DEPTH} WHERE split = 'train' GROUP BY node)""")
    return ctes


def _one_tree(spark, sf):
    ft = _ev_table(spark, sf, drop_incomplete=False)
    return ft, T.fit(ft.where(F.col("split") == "train"), _TREE_FEATURES, "qty_sold", rounds=1, depth=_TREE_DEPTH)


@register("boosted_tree_cuts", O.with_(*_tree_sql()) + """SELECT 0 AS tree, CAST(node AS INT) AS node, feature, threshold, CASE WHEN missing_left THEN 'left' ELSE 'right' END AS missing, gain,
  CAST(n AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS value FROM cut
UNION ALL SELECT 0, CAST(node AS INT), NULL, NULL, NULL, NULL, n, value FROM leaf""", fuzz=("gain", "value"), ops=("M3",))
def q_boosted_tree_cuts(spark, sf):
    """Nodes of one second-order tree (depth 3) on features with missing values: cut, learned direction of
    missing values, gain, rows, and the weight of leaves."""
    _, model = _one_tree(spark, sf)
    return model.table(spark)


@register("boosted_tree_predictions", O.with_(*_tree_sql()) + f"""SELECT r.split, r.itemID, r.date, base + value AS prediction
FROM rows{_TREE_DEPTH} r JOIN leaf USING (node), start""", fuzz=("prediction",), ops=("M3", "M4"))
def q_boosted_tree_predictions(spark, sf):
    """What that tree predicts for every (item, day) of both splits."""
    ft, model = _one_tree(spark, sf)
    return model.predict(ft).select("split", "itemID", "date", "prediction")


#: Rounds of the registered query; the library's default is the reference's 50.
BOOSTED_ROUNDS = 10


@register("model_boosted_scores", None, ops=("M1", "M2", "M3", "M4", "M5", "M6"))
def q_model_boosted_scores(spark, sf):
    """Second-order boosted trees (depth 5, rate 0.1, 10 rounds) on all 40 features, missing values and all:
    accuracy and R2 of rounded test predictions."""
    ft = _ev_table(spark, sf, drop_incomplete=False)
    order = written(C.category_order(ft.where(F.col("split") == "train"), _CATS, "qty_sold"))
    ready = C.encoded(ft, order, _CATS)
    model = T.fit(ready.where(F.col("split") == "train"), MODEL_FEATURES, "qty_sold", rounds=BOOSTED_ROUNDS)
    test = model.predict(ready.where(F.col("split") == "test")).withColumns(
        {"label": F.col("qty_sold").cast("double"), "pred": F.rint("prediction")})
    return M.scores(test)
