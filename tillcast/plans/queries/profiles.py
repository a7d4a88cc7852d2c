"""Matrix, totals, profiles, histograms, samples, summaries and data checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillcast.operators import prepare as P
from tillcast.operators import profile as PR
from tillcast.plans import features as E1
from tillcast.plans import oracle as O
from tillcast.plans.registry import register
from tillcast.sources import fixtures as FX
from tillcast.plans.queries.common import (
    DC, EC, EDA_CTES, LC, LINES_CTES, MATRIX_CTES, QUARTER, SPLIT_SQL, _all_txn, _eda_txn, _ev, _every, _li,
    _matrix, _profile, _res, _split_txn, _train, split_sql)


# --- matrix, totals, profiles (A15-A18, A22-A24, W9, W12, W13, Q6) ---------------------

@register("date_item_matrix", O.with_(*MATRIX_CTES) + "SELECT * FROM matrix",
          fuzz=(("total_values", 2),), ops=("A17", "T1"))
def q_date_item_matrix(spark, sf):
    """Units and value per (date, item), every calendar day, gaps 0 (long form)."""
    return _matrix(spark, sf)


@register("totals_per_day", O.with_(O.LINEITEM_ALL.txn) + f"""SELECT CAST(time AS DATE) AS date,
  CAST(sum("order") AS BIGINT) AS total_orders, coalesce({O.xsum('"order" * salesPrice')}, 0) AS total_values
FROM txn GROUP BY CAST(time AS DATE)""", fuzz=(("total_values", 2),), ops=("A15",))
def q_totals_per_day(spark, sf):
    """Units and value per day."""
    return PR.totals_per_day(_all_txn(spark, sf))


@register("totals_per_item", O.with_(*EDA_CTES) + f"""SELECT itemID, CAST(sum("order") AS BIGINT) AS "order",
  coalesce({O.xsum('"order" * salesPrice')}, 0) AS value, bool_or(in_promotion) AS in_promotion
FROM eda GROUP BY itemID""", fuzz=(("value", 2),), ops=("A16",))
def q_totals_per_item(spark, sf):
    """Per item units, value and whether ever on promotion."""
    return PR.totals_per_item(P.price_levels(_eda_txn(spark, sf), keys=["itemID"]))


@register("value_counts", O.with_(O.LINEITEM_ALL.txn)
          + "SELECT itemID, count(*) AS count FROM txn GROUP BY itemID", ops=("A18", "O1"))
def q_value_counts(spark, sf):
    """Order lines per item, most frequent first."""
    return PR.value_counts(_every(spark, sf))


@register("reconciliation", O.with_(*MATRIX_CTES) + f"""SELECT coalesce(a.itemID, b.itemID) AS itemID, a.s1, b.s2,
  abs(coalesce(a.s1, 0) - coalesce(b.s2, 0)) <= 1e-8 + 1e-9 * abs(coalesce(b.s2, 0)) AS ok
FROM (SELECT itemID, coalesce({O.xsum('"order" * salesPrice')}, 0) AS s1 FROM txn GROUP BY itemID) a
FULL JOIN (SELECT itemID, {O.xsum('total_values')} AS s2 FROM matrix GROUP BY itemID) b ON a.itemID = b.itemID""",
          fuzz=(("s1", 2), ("s2", 2)), ops=("Q6",))
def q_reconciliation(spark, sf):
    """Line total and matrix total of every item, and whether they agree."""
    return PR.reconciliation(_all_txn(spark, sf), _matrix(spark, sf))


@register("sale_day_profile", O.with_(*MATRIX_CTES) + "SELECT * FROM prof",
          fuzz=("avg_value_sale_day",), ops=("A22",))
def q_sale_day_profile(spark, sf):
    """Per item total value, sale days, value per sale day."""
    return _profile(spark, sf)


_PCOLS = ["total_value", "n_sale_days", "avg_value_sale_day"]


@register("profile_correlation", O.with_(*MATRIX_CTES) + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS corr FROM prof"
    for a in _PCOLS for b in _PCOLS), fuzz=("corr",), ops=("A23",))
def q_profile_correlation(spark, sf):
    """Pearson correlations of the sale-day profile columns."""
    return PR.profile_correlation(_profile(spark, sf))


@register("items_above_k", O.with_(*MATRIX_CTES) + "\nUNION ALL\n".join(
    f"SELECT {k} AS k, count(*) FILTER (WHERE n_sale_days > {k}) AS n_items FROM prof"
    for k in (1, 5, 25, 50, 100)), ops=("A24",))
def q_items_above_k(spark, sf):
    """Items sold on more than k days, k = 1, 5, 25, 50, 100."""
    return PR.items_above(_profile(spark, sf))


@register("concentration_curve", O.with_(*MATRIX_CTES) + """SELECT itemID, total_value,
  row_number() OVER (ORDER BY total_value, itemID) AS position,
  sum(total_value) OVER (ORDER BY total_value, itemID ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_value
FROM prof""", fuzz=(("cum_value", 2),), ops=("W12",))
def q_concentration_curve(spark, sf):
    """Cumulative value over items sorted by value."""
    return PR.concentration_curve(_profile(spark, sf))


@register("ranked_by_value", O.with_(*MATRIX_CTES) + """SELECT itemID, total_value,
  row_number() OVER (ORDER BY total_value DESC, itemID) AS rank FROM prof""",
          ops=("W13",))
def q_ranked_by_value(spark, sf):
    """Items ranked by total value."""
    return PR.ranked_profile(_profile(spark, sf), "total_value")


@register("ranked_by_sale_days", O.with_(*MATRIX_CTES) + """SELECT itemID, n_sale_days,
  row_number() OVER (ORDER BY n_sale_days DESC, itemID) AS rank FROM prof""", ops=("W13",))
def q_ranked_by_sale_days(spark, sf):
    """Items ranked by number of sale days."""
    return PR.ranked_profile(_profile(spark, sf), "n_sale_days")


@register("rolling_value_14", O.with_(*MATRIX_CTES) + """SELECT itemID, date, avg(total_values) OVER w AS rolling_mean
FROM matrix WINDOW w AS (PARTITION BY itemID ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)
QUALIFY count(total_values) OVER w = 14""", fuzz=("rolling_mean",), ops=("W9",))
def q_rolling_value_14(spark, sf):
    """14-day rolling mean of daily value per item, incomplete windows dropped."""
    return PR.rolling_value_mean(_matrix(spark, sf, 14), 14)




# --- histograms (A25-A27, F11) -----------------------------------------------------------

def hist_sql(src: str, col: str, bins: int) -> str:
    """SQL for :func:`tillcast.operators.profile.histogram` over CTE ``src``."""
    return f"""hx AS (SELECT CAST({col} AS DOUBLE) AS x FROM {src} WHERE {col} IS NOT NULL),
hs AS (SELECT min(x) AS lo, max(x) AS hi, count(*) AS n FROM hx),
hb AS (SELECT CASE WHEN hs.hi > hs.lo
                   THEN least(CAST(floor((x - hs.lo) / (hs.hi - hs.lo) * {bins}) AS INT) + 1, {bins})
                   ELSE 1 END AS bin, count(*) AS count
       FROM hx, hs GROUP BY 1)
SELECT bin, hs.lo + (bin - 1) * ((hs.hi - hs.lo) / {bins}) AS bin_lo,
       CASE WHEN bin = {bins} THEN hs.hi ELSE hs.lo + bin * ((hs.hi - hs.lo) / {bins}) END AS bin_hi,
       count, CAST(count AS DOUBLE) / hs.n * 100 AS pct
FROM hb, hs"""


HFUZZ = ("bin_lo", "bin_hi", "pct")


@register("hist_discount", O.with_(*LINES_CTES, "tl AS (SELECT * FROM lines WHERE split = 'train')",
                                   hist_sql("tl", "discountPerc", 10).split("\nSELECT")[0])
          + "SELECT" + hist_sql("tl", "discountPerc", 10).split("\nSELECT", 1)[1],
          fuzz=HFUZZ, ops=("A25",))
def q_hist_discount(spark, sf):
    """10-bin histogram of train discount shares, counts and %."""
    return PR.histogram(P.price_levels(_train(spark, sf)), "discountPerc", 10, weight="lines")


def _hist_query(name, src_sql, col, bins, build, ops):
    body = hist_sql("hsrc", col, bins)
    head, tail = body.split("\nSELECT", 1)
    register(name, O.with_(*EDA_CTES, f"hsrc AS ({src_sql})", head) + "SELECT" + tail,
             fuzz=HFUZZ, ops=ops)(build)


_hist_query("hist_daily_units", 'SELECT date, sum("order") AS units FROM res GROUP BY date',
            "units", 30,
            lambda spark, sf: PR.histogram(
                _res(spark, sf).groupBy("date").agg(F.sum("order").alias("units")), "units", 30),
            ("A25", "A15"))


_hist_query("hist_item_units", 'SELECT itemID, sum("order") AS units FROM res GROUP BY itemID',
            "units", 30,
            lambda spark, sf: PR.histogram(
                _res(spark, sf).groupBy("itemID").agg(F.sum("order").alias("units")), "units", 30),
            ("A25", "A16"))


_hist_query("hist_item_units_promo",
            'SELECT itemID, sum("order") AS units FROM res GROUP BY itemID HAVING bool_or(in_promotion)',
            "units", 30,
            lambda spark, sf: PR.histogram(
                _res(spark, sf).groupBy("itemID").agg(F.sum("order").alias("units"),
                                                      F.bool_or("in_promotion").alias("p"))
                .where("p"), "units", 30),
            ("A25", "A16"))


_hist_query("hist_item_units_regular",
            'SELECT itemID, sum("order") AS units FROM res GROUP BY itemID HAVING NOT bool_or(in_promotion)',
            "units", 30,
            lambda spark, sf: PR.histogram(
                _res(spark, sf).groupBy("itemID").agg(F.sum("order").alias("units"),
                                                      F.bool_or("in_promotion").alias("p"))
                .where(~F.col("p")), "units", 30),
            ("A25", "A16"))


_hist_query("hist_daily_row_units", 'SELECT "order" AS units FROM res', "units", 30,
            lambda spark, sf: PR.histogram(
                _res(spark, sf).select(F.col("order").alias("units")), "units", 30), ("A25",))


_hist_query("hist_promotion_row_price", "SELECT weightedAveragePrice FROM res WHERE in_promotion", "weightedAveragePrice", 30,
            lambda spark, sf: PR.histogram(_res(spark, sf).where("in_promotion"), "weightedAveragePrice", 30), ("A25",))


_hist_query("hist_regular_row_price", "SELECT weightedAveragePrice FROM res WHERE NOT in_promotion", "weightedAveragePrice", 30,
            lambda spark, sf: PR.histogram(_res(spark, sf).where("not in_promotion"), "weightedAveragePrice", 30), ("A25",))


_hist_query("hist_price", "SELECT weightedAveragePrice FROM res", "weightedAveragePrice", 30,
            lambda spark, sf: PR.histogram(_res(spark, sf), "weightedAveragePrice", 30), ("A25",))


_hist_query("hist_log_units", 'SELECT ln("order") AS log_order FROM res', "log_order", 30,
            lambda spark, sf: PR.histogram(PR.log_values(_res(spark, sf), "order"),
                                           "log_order", 30), ("A27", "F11"))


_hist_query("hist_log_daily_units",
            'SELECT date, sum(ln("order")) AS log_units FROM res GROUP BY date', "log_units", 30,
            lambda spark, sf: PR.histogram(
                PR.log_values(_res(spark, sf), "order").groupBy("date")
                .agg(F.sum("log_order").alias("log_units")), "log_units", 30), ("A27", "F11"))


@register("hist_price_per_item", O.with_(*O.pipeline_ctes(O.LINEITEM_ALL, "prep")) + """, pm AS (
  SELECT itemID, min(salesPrice) AS lo, max(salesPrice) AS hi FROM prep WHERE split = 'train' GROUP BY itemID)
SELECT p.itemID, CASE WHEN pm.hi > pm.lo
    THEN least(CAST(floor((p.salesPrice - pm.lo) / (pm.hi - pm.lo) * 10) AS INT) + 1, 10) ELSE 1 END AS bin,
  count(*) AS count
FROM prep p JOIN pm ON p.itemID = pm.itemID WHERE p.split = 'train' AND p.salesPrice IS NOT NULL
GROUP BY 1, 2""".replace("\n, pm AS", ",\npm AS"), ops=("A26",))
def q_hist_price_per_item(spark, sf):
    """10-bin price histogram within each item (train lines)."""
    return PR.histogram_per_item(_train(spark, sf), "salesPrice", 10)




# --- samples (O3, O4, J5, J7, P15, P16, F10) ------------------------------------------------

SAMPLE_SEED = 1


@register("sampled_results", O.with_(*EDA_CTES, f"""smp AS (
  SELECT itemID FROM (SELECT DISTINCT itemID FROM res)
  ORDER BY {O.uniform(['itemID', str(SAMPLE_SEED)])}, itemID LIMIT 100),
sres AS (SELECT * FROM res WHERE itemID IN (SELECT itemID FROM smp))""")
          + """SELECT itemID, date, "order", weightedAveragePrice, in_promotion,
  CAST(date_diff('day', (SELECT min(date) FROM sres), date) + 1 AS INT) AS days_from_start
FROM sres""", fuzz=("weightedAveragePrice",), ops=("O4", "J5", "P15", "F10"))
def q_sampled_results(spark, sf):
    """Results rows of 100 items chosen by seeded md5, with day number from start."""
    from tillcast.functions import days_from_start
    res = _res(spark, sf)
    items = PR.sample_items(res, 100, SAMPLE_SEED)
    s = res.join(items, "itemID", "left_semi")
    first = s.select(F.min("date")).scalar()
    return s.select("itemID", "date", "order", "weightedAveragePrice", "in_promotion",
                    days_from_start("date", first).alias("days_from_start"))


DEEP_SHARE = 0.79


DEEP_SEED = 222


LINE_KEY_SQL = ["itemID", "strftime(time, '%Y-%m-%d %H:%M:%S.%f')", "CAST(round_even(salesPrice * 100, 0) AS BIGINT)"]


@register("deep_discount_sample", O.with_(*O.pipeline_ctes(O.EVENTS, "lines"), f"""dd AS (
  SELECT itemID FROM lines WHERE split = 'train' AND discountPerc > {DEEP_SHARE}
  ORDER BY {O.uniform([*LINE_KEY_SQL, str(DEEP_SEED)])}, itemID LIMIT 50)""")
          + """SELECT dd.itemID, l.time, l.salesPrice, l."order"
FROM dd LEFT JOIN (SELECT * FROM lines WHERE split = 'train') l ON dd.itemID = l.itemID""",
          ops=("P16", "O4", "J7"))
def q_deep_discount_sample(spark, sf):
    """50 seeded order lines with a discount share above 0.79, fanned out to all of their
    items' train lines (repeated keys multiply rows)."""
    tr = P.prepared_transactions(_ev(spark, sf), EC).where(F.col("split") == "train")
    deep = P.enrich_transactions(tr).where(F.col("discountPerc") > DEEP_SHARE)
    sample = PR.seeded_sample(deep, 50, DEEP_SEED, PR.line_key()).select("itemID")
    return F.broadcast(sample).join(tr.select("itemID", "time", "salesPrice", "order"), "itemID", "left")


@register("gap_items_histograms", O.with_(*O.pipeline_ctes(O.LINEITEM_ALL, "prep"), f"""gs AS (
  SELECT itemID, {O.xavg('salesPrice')} AS m, median(salesPrice) AS md FROM prep WHERE split = 'train' GROUP BY itemID),
g50 AS (SELECT itemID FROM gs
  ORDER BY {O.r2('abs(abs(m - md) / nullif(md, 0)) * 100')} DESC NULLS LAST, itemID LIMIT 50),
gl AS (SELECT p.itemID, p.salesPrice FROM prep p JOIN g50 ON p.itemID = g50.itemID WHERE p.split = 'train' AND p.salesPrice IS NOT NULL),
gm AS (SELECT itemID, min(salesPrice) AS lo, max(salesPrice) AS hi FROM gl GROUP BY itemID)""")
          + """SELECT gl.itemID, CASE WHEN gm.hi > gm.lo
    THEN least(CAST(floor((gl.salesPrice - gm.lo) / (gm.hi - gm.lo) * 10) AS INT) + 1, 10) ELSE 1 END AS bin, count(*) AS count
FROM gl JOIN gm ON gl.itemID = gm.itemID GROUP BY 1, 2""", ops=("J7", "A26", "O2"))
def q_gap_items_histograms(spark, sf):
    """Price histograms of the 50 items with the largest mean/median gap, over all their train lines."""
    tr = _train(spark, sf)
    top = PR.top_k(P.mean_median_gap(tr), "abs_perc_diff", 50).select("itemID")
    return PR.histogram_per_item(tr.join(F.broadcast(top), "itemID"), "salesPrice", 10)


@register("preview_orders", O.with_(O.LINEITEM_ALL.txn)
          + 'SELECT * FROM txn ORDER BY time, itemID, "order", salesPrice LIMIT 10', ops=("O3",))
def q_preview_orders(spark, sf):
    """First 10 order lines in (time, itemID, order, price) order."""
    return PR.preview(FX.transactions(spark, sf, None), 10)




# --- summaries and checks (Q1-Q5, Q7, Q8, A19, A20, A28, A29, J4) --------------------------

def _num_sql(cols):
    parts = []
    for c in cols:
        x = f'CAST("{c}" AS DOUBLE)'
        parts.append(f"""SELECT '{c}' AS "column", count({x}) AS count, avg({x}) AS mean,
  stddev_samp({x}) AS std, min({x}) AS min, quantile_cont({x}, 0.25) AS p25,
  quantile_cont({x}, 0.5) AS p50, quantile_cont({x}, 0.75) AS p75, max({x}) AS max FROM txn""")
    return "\nUNION ALL\n".join(parts)


@register("numeric_summary", O.with_(O.LINEITEM_ALL.txn) + _num_sql(["itemID", "order", "salesPrice"]),
          fuzz=("mean", "std", "p25", "p50", "p75"), ops=("Q1",))
def q_numeric_summary(spark, sf):
    """count, mean, std, min, exact quartiles, max of the numeric order columns."""
    return PR.numeric_summary(_every(spark, sf), ["itemID", "order", "salesPrice"])


def _str_sql(cols):
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS "column", CAST(sum(n) AS BIGINT) AS count, count(*) AS "unique",
  arg_min(v, (-n, v)) AS top, max(n) AS freq
FROM (SELECT {c} AS v, count(*) AS n FROM items_v WHERE {c} IS NOT NULL GROUP BY {c})""")
    return "\nUNION ALL\n".join(parts)


@register("string_summary", O.with_(O.LINEITEM.items) + _str_sql(["category1", "category3"]),
          ops=("Q2",))
def q_string_summary(spark, sf):
    """count, unique, top, freq of the string item columns."""
    return PR.string_summary(FX.items(spark, sf), ["category1", "category3"])


_ITEM_TYPES = [("itemID", "bigint"), ("brand", "int"), ("manufacturer", "int"),
               ("customerRating", "double"), ("category1", "string"), ("category2", "int"),
               ("category3", "string"), ("recommendedRetailPrice", "double")]


@register("column_inventory", O.with_(O.LINEITEM.items) + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", '{t}' AS type, count({c}) AS non_null FROM items_v"""
    for c, t in _ITEM_TYPES), ops=("Q3",))
def q_column_inventory(spark, sf):
    """Type and non-NULL count of each item column."""
    return PR.column_inventory(FX.items(spark, sf))


@register("uniqueness_check", O.with_(O.LINEITEM.items, O.LINEITEM.infos) + """SELECT a.infos_rows, a.max_per_item, b.items_rows,
  a.max_per_item = 1 AS unique_items, a.infos_rows = b.items_rows AS same_count
FROM (SELECT CAST(sum(n) AS BIGINT) AS infos_rows, max(n) AS max_per_item
      FROM (SELECT itemID, count(*) AS n FROM infos_v GROUP BY itemID)) a,
     (SELECT count(*) AS items_rows FROM items_v) b""", ops=("Q4",))
def q_uniqueness_check(spark, sf):
    """infos has one row per item and as many rows as items."""
    return PR.uniqueness_check(FX.infos(spark, sf), FX.items(spark, sf))


@register("referential_check", O.with_(O.LINEITEM.items, O.LINEITEM.infos) + """SELECT count(*) AS n_missing, count(*) = 0 AS all_known
FROM infos_v f WHERE NOT EXISTS (SELECT 1 FROM items_v i WHERE i.itemID = f.itemID)""",
          ops=("Q5",))
def q_referential_check(spark, sf):
    """infos items missing from items (expected: none)."""
    return PR.referential_check(FX.infos(spark, sf), FX.items(spark, sf))


@register("shape_results", O.with_(*EDA_CTES)
          + "SELECT count(*) AS n_rows, CAST(18 AS INT) AS n_cols FROM res", ops=("Q8",))
def q_shape_results(spark, sf):
    """Rows and columns of the exploration results table."""
    return PR.shape(_res(spark, sf).drop("split"))


@register("retention", O.with_(*O.pipeline_ctes(O.LINEITEM, "feat", drop_incomplete=False))
          + f"""SELECT split, count(*) AS rows_before,
  count(*) FILTER (WHERE qty_sold_lag1 IS NOT NULL AND qty_sold_lag2 IS NOT NULL AND qty_sold_lag3 IS NOT NULL AND qty_sold_lag7 IS NOT NULL) AS rows_kept,
  {O.r2("CAST(count(*) FILTER (WHERE qty_sold_lag1 IS NOT NULL AND qty_sold_lag2 IS NOT NULL AND qty_sold_lag3 IS NOT NULL AND qty_sold_lag7 IS NOT NULL) AS DOUBLE) / count(*) * 100")} AS kept_pct
FROM feat GROUP BY split""", ops=("Q7", "P13"))
def q_retention(spark, sf):
    """Rows kept when incomplete lag rows are dropped, per split."""
    from tillcast.operators.features import retention
    return retention(E1.feature_table(_li(spark, sf), FX.items(spark, sf), LC,
                                      drop_incomplete=False))


@register("lost_items", O.with_(O.LINEITEM_ALL.txn, SPLIT_SQL)
          + "SELECT itemID, 'yes' AS will_be_lost FROM lost", ops=("J4",))
def q_lost_items(spark, sf):
    """Items sold in test but never in train."""
    return PR.lost_items(_split_txn(spark, sf))


@register("lost_revenue", O.with_(O.LINEITEM_ALL.txn, SPLIT_SQL) + f"""SELECT count(DISTINCT l.itemID) AS n_lost_items,
  {O.r2(O.xsum('CASE WHEN l.itemID IS NOT NULL THEN "order" * salesPrice END') + ' / nullif(' + O.xsum('"order" * salesPrice') + ', 0) * 100')} AS lost_revenue_pct
FROM sp LEFT JOIN lost l ON sp.itemID = l.itemID""", ops=("J4", "A19"))
def q_lost_revenue(spark, sf):
    """Revenue share (%) of items lost by the split (before zero prices are removed)."""
    return PR.lost_revenue_share(_split_txn(spark, sf))


@register("item_coverage", O.with_(*O.LINEITEM_ALL.views(), O.prep(QUARTER)) + f"""SELECT n_sold, n_items,
  {O.r2('CAST(n_sold AS DOUBLE) / nullif(n_items, 0) * 100')} AS coverage_pct
FROM (SELECT (SELECT count(DISTINCT itemID) FROM prep WHERE split = 'train') AS n_sold,
             (SELECT count(*) FROM items_v) AS n_items)""", ops=("A20",))
def q_item_coverage(spark, sf):
    """Share of all items with a train order (after zero prices are removed)."""
    train = P.drop_zero_prices(_split_txn(spark, sf)).where(F.col("split") == "train")
    return PR.item_coverage(train, FX.items(spark, sf))


@register("zero_price_share", O.with_(O.LINEITEM_ALL.txn, split_sql(DC))
          + "SELECT avg(CAST(salesPrice = 0 AS DOUBLE)) * 100 AS zero_price_pct FROM sp WHERE split = 'train'",
          fuzz=("zero_price_pct",), ops=("A29",))
def q_zero_price_share(spark, sf):
    """% of train lines at price 0."""
    return PR.zero_price_share(_all_txn(spark, sf).where(F.col("split") == "train"))


@register("distinct_items", O.with_(O.LINEITEM_ALL.txn)
          + "SELECT count(DISTINCT itemID) AS n_items FROM txn", ops=("A28",))
def q_distinct_items(spark, sf):
    """Number of distinct items ordered."""
    return PR.distinct_items(_every(spark, sf))




# --- promotion dates of the simulation period (F13, F14, P18) ------------------------------

@register("promotion_dates", O.with_(O.LINEITEM.infos) + """SELECT itemID, CAST(trim(d) AS DATE) AS promo_date
FROM (SELECT itemID, unnest(string_split(promotion, ',')) AS d FROM infos_v WHERE promotion IS NOT NULL)""",
          ops=("F13",))
def q_promotion_dates(spark, sf):
    """One row per (item, promotion date) of the simulation period."""
    from tillcast.functions import promotion_dates
    return FX.infos(spark, sf).select(
        "itemID", F.explode(promotion_dates("promotion")).alias("promo_date"))


@register("promotion_calendar", O.with_(O.LINEITEM.infos) + f"""SELECT f.itemID, CAST(g.d AS DATE) AS date,
  coalesce(list_contains(list_transform(string_split(f.promotion, ','), lambda x: CAST(trim(x) AS DATE)), CAST(g.d AS DATE)), false) AS promotion
FROM infos_v f JOIN (SELECT unnest(generate_series({O.d(LC.forecast_start)}, {O.d(LC.forecast_end)}, INTERVAL 1 DAY)) AS d) g ON TRUE""",
          ops=("F13", "T1"))
def q_promotion_calendar(spark, sf):
    """Daily promotion flag of every item over the 14 forecast days."""
    from tillcast.functions import promotion_dates
    infos = FX.infos(spark, sf).select("itemID", promotion_dates("promotion").alias("dates"))
    days = F.sequence(F.lit(LC.forecast_start).cast("date"), F.lit(LC.forecast_end).cast("date"))
    g = infos.select("itemID", "dates", F.explode(days).alias("date"))
    return g.select("itemID", "date",
                    F.coalesce(F.array_contains("dates", F.col("date")), F.lit(False))
                    .alias("promotion"))


@register("multi_promotion_infos", O.with_(O.LINEITEM.infos)
          + "SELECT itemID, promotion, CAST(length(promotion) AS INT) AS promo_len FROM infos_v WHERE length(promotion) > 10",
          ops=("P18", "F14"))
def q_multi_promotion_infos(spark, sf):
    """Infos rows with several promotion dates (text longer than one date)."""
    return (FX.infos(spark, sf).withColumn("promo_len", F.length("promotion"))
            .where(F.col("promo_len") > 10).select("itemID", "promotion", "promo_len"))




# --- more summaries: infos strings (Q2), orders columns (Q3) -----------------------------

@register("string_summary_infos", O.with_(O.LINEITEM.infos) + """SELECT 'promotion' AS "column", CAST(sum(n) AS BIGINT) AS count, count(*) AS "unique",
  arg_min(v, (-n, v)) AS top, max(n) AS freq
FROM (SELECT promotion AS v, count(*) AS n FROM infos_v WHERE promotion IS NOT NULL GROUP BY promotion)""",
          ops=("Q2",))
def q_string_summary_infos(spark, sf):
    """count, unique, top, freq of the infos promotion text."""
    return PR.string_summary(FX.infos(spark, sf), ["promotion"])


_ORDER_TYPES = [("time", "timestamp_ntz"), ("itemID", "bigint"), ("order", "int"),
                ("salesPrice", "double")]


@register("column_inventory_orders", O.with_(O.LINEITEM_ALL.txn) + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", '{t}' AS type, count("{c}") AS non_null FROM txn"""
    for c, t in _ORDER_TYPES), ops=("Q3",))
def q_column_inventory_orders(spark, sf):
    """Type and non-NULL count of each order column."""
    return PR.column_inventory(FX.transactions(spark, sf, None))


# --- wide date x item matrix (A17) ------------------------------------------------------

TOP_ITEMS = 10


_RANKS = range(1, TOP_ITEMS + 1)


@register("wide_matrix_top_items", O.with_(*MATRIX_CTES, f"""top AS (
  SELECT itemID, row_number() OVER (ORDER BY n DESC, itemID) AS r
  FROM (SELECT itemID, count(*) AS n FROM txn GROUP BY itemID) QUALIFY r <= {TOP_ITEMS})""")
          + "SELECT date, " + ", ".join(
              f"CAST(sum(CASE WHEN r = {k} THEN total_orders ELSE 0 END) AS BIGINT) AS item_{k}" for k in _RANKS)
          + " FROM matrix m JOIN top ON m.itemID = top.itemID GROUP BY date", ops=("A17", "O2"))
def q_wide_matrix_top_items(spark, sf):
    """Top-k report: daily units of the 10 items with the most order lines, a column per rank."""
    from tillcast.operators.grid import wide_by_rank
    top = PR.value_counts(_every(spark, sf)).limit(TOP_ITEMS)
    return wide_by_rank(_matrix(spark, sf), top.select("itemID", "count"), TOP_ITEMS)
