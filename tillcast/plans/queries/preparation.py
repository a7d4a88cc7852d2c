"""Fixture views and transaction preparation: promotion flags, prices, discounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillcast.operators import prepare as P
from tillcast.plans import oracle as O
from tillcast.plans.registry import register
from tillcast.sources import fixtures as FX
from tillcast.plans.queries.common import (
    EC, _ev, _prep, _train)


# --- fixture views (P1, P9) -----------------------------------------------------------

@register("orders_view", O.with_(O.LINEITEM_ALL.txn) + 'SELECT time, itemID, "order", salesPrice FROM txn',
          ops=("P1", "P9", "S1"))
def q_orders_view(spark, sf):
    """Orders view (time, itemID, order, salesPrice) over lineitem x part."""
    return FX.transactions(spark, sf, None)


@register("items_view", O.with_(O.LINEITEM_ALL.items) + "SELECT * FROM items_v", ops=("P9", "S2"))
def q_items_view(spark, sf):
    """Item master view."""
    return FX.items(spark, sf)


@register("infos_view", O.with_(O.LINEITEM_ALL.infos) + "SELECT * FROM infos_v", ops=("S3",))
def q_infos_view(spark, sf):
    """Infos view."""
    return FX.infos(spark, sf)




# --- transaction preparation (W1-W4, F2, F3, F5, A4-A7, A21) -----------------------------

LINE_COLS = ("split, itemID, date, time, \"order\", salesPrice, orderValue, maxPrice, minPrice, "
             "item_prices_count, promotion, discountAmount, discountPerc")


@register("txn_enriched", O.with_(*O.pipeline_ctes(O.LINEITEM_ALL, "lines"), """ipc AS (
  SELECT split, itemID, count(DISTINCT salesPrice) AS item_prices_count FROM prep GROUP BY split, itemID)""")
          + f"SELECT {LINE_COLS.replace('item_prices_count', 'ipc.item_prices_count').replace('split, itemID,', 'l.split, l.itemID,', 1)} "
          "FROM lines l JOIN ipc ON l.split = ipc.split AND l.itemID = ipc.itemID",
          ops=("W1", "W2", "W4", "F2", "P5", "P10", "P11", "P12"))
def q_txn_enriched(spark, sf):
    """Order lines with item max/min price, distinct price count, promotion, discount."""
    return P.single_lines(P.enrich_transactions(_prep(spark, sf))).select(
        "split", "itemID", "date", "time", "order", "salesPrice", "orderValue", "maxPrice",
        "minPrice", "item_prices_count", "promotion", "discountAmount", "discountPerc")


def _running_sql(fx):
    return O.with_(*O.pipeline_ctes(fx, "prep")) + """SELECT split, itemID, time, salesPrice,
  max(salesPrice) OVER w AS runningMaxPrice,
  coalesce(CAST(salesPrice < max(salesPrice) OVER w AS INT), 0) AS in_promotion_hist
FROM prep
WINDOW w AS (PARTITION BY split, itemID ORDER BY time RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


@register("promo_running_max", _running_sql(O.LINEITEM_ALL), ops=("W3",))
def q_promo_running_max(spark, sf):
    """Promotion flag against the running maximum price (lines with equal time are peers)."""
    return P.single_lines(P.running_max_promotion(_prep(spark, sf))).select(
        "split", "itemID", "time", "salesPrice", "runningMaxPrice", "in_promotion_hist")


@register("promo_running_max_events", _running_sql(O.EVENTS), ops=("W3",))
def q_promo_running_max_events(spark, sf):
    """Running-maximum promotion flag on the events fixture (real times of day)."""
    lines = P.prepared_transactions(_ev(spark, sf), EC).select("split", "itemID", "time", "salesPrice")
    return P.running_max_promotion(lines).select(
        "split", "itemID", "time", "salesPrice", "runningMaxPrice", "in_promotion_hist")


@register("promo_vs_rrp", O.with_(*O.pipeline_ctes(O.LINEITEM_ALL, "prep")) + """SELECT p.itemID, p.time, p.salesPrice, i.recommendedRetailPrice,
  coalesce(CAST(p.salesPrice < i.recommendedRetailPrice AS INT), 0) AS in_promotion_rrp
FROM prep p LEFT JOIN items_v i ON p.itemID = i.itemID""", ops=("F5",))
def q_promo_vs_rrp(spark, sf):
    """Promotion flag against the recommended retail price."""
    return P.single_lines(P.promotion_vs_retail_price(_prep(spark, sf), FX.items(spark, sf))).select(
        "itemID", "time", "salesPrice", "recommendedRetailPrice", "in_promotion_rrp")


@register("median_discount", O.with_(*O.pipeline_ctes(O.LINEITEM_ALL, "lines"), O.MED)
          + "SELECT i.itemID, m.medianDiscPerc FROM items_v i LEFT JOIN med m ON i.itemID = m.itemID",
          ops=("A6", "P14", "J1"))
def q_median_discount(spark, sf):
    """Median of distinct non-zero discount shares per item (all items, NULL if none)."""
    return P.discount_stats(FX.items(spark, sf), _train(spark, sf))


@register("infos_discounted", O.with_(*O.pipeline_ctes(O.LINEITEM_ALL, "lines"), O.MED)
          + f"""SELECT f.itemID, f.simulationPrice, f.promotion, m.medianDiscPerc,
  CASE WHEN f.promotion IS NOT NULL THEN {O.r2('f.simulationPrice * (1 - m.medianDiscPerc)')} END AS discountedPrice
FROM infos_v f LEFT JOIN med m ON f.itemID = m.itemID""", ops=("J1", "F3", "P11", "P12"))
def q_infos_discounted(spark, sf):
    """Infos with median discount and discounted simulation price."""
    return P.infos_with_discount(FX.infos(spark, sf), FX.items(spark, sf), _train(spark, sf))


@register("price_variations", O.with_(*O.pipeline_ctes(O.LINEITEM_ALL, "prep")) + """SELECT itemID, date, count(DISTINCT salesPrice) AS unique_price_count
FROM prep WHERE split = 'train' GROUP BY itemID, date HAVING count(DISTINCT salesPrice) > 1""",
          ops=("A4",))
def q_price_variations(spark, sf):
    """(item, day) pairs of train sold at several prices."""
    return P.price_variations(_train(spark, sf))


@register("price_variations_events", O.with_(*O.pipeline_ctes(O.EVENTS, "prep")) + """SELECT itemID, date, count(DISTINCT salesPrice) AS unique_price_count
FROM prep WHERE split = 'train' GROUP BY itemID, date HAVING count(DISTINCT salesPrice) > 1""",
          ops=("A4",))
def q_price_variations_events(spark, sf):
    """Several-price (item, day) pairs of the events fixture."""
    return P.price_variations(P.prepared_transactions(_ev(spark, sf), EC)
                              .where(F.col("split") == "train"))


@register("several_price_share", O.with_(*O.pipeline_ctes(O.LINEITEM_ALL, "prep")) + """, pairs AS (
  SELECT itemID, date, count(DISTINCT salesPrice) AS n FROM prep WHERE split = 'train' GROUP BY itemID, date),
c AS (SELECT (SELECT count(*) FILTER (WHERE n > 1) FROM pairs) AS multi_pairs,
             (SELECT count(*) FROM pairs) AS all_pairs, (SELECT count(*) FROM items_v) AS n_items)
SELECT multi_pairs, all_pairs, n_items,
  CAST(multi_pairs AS DOUBLE) / n_items * 100 AS pairs_per_item_pct,
  CAST(multi_pairs AS DOUBLE) / all_pairs * 100 AS pairs_share_pct FROM c""".replace(
              "\n, pairs", ",\npairs", 1), ops=("A5",))
def q_several_price_share(spark, sf):
    """Several-price pairs per item (%) and share of all sold pairs (%)."""
    return P.several_price_share(_train(spark, sf), FX.items(spark, sf))


MEAN_MEDIAN_SQL = f"""s AS (SELECT itemID, {O.xavg('salesPrice')} AS mean_price, median(salesPrice) AS median_price
  FROM prep WHERE split = 'train' GROUP BY itemID),
mm AS (SELECT itemID, {O.r2('mean_price')} AS mean_price, {O.r2('median_price')} AS median_price,
  {O.r2('abs(mean_price - median_price)')} AS abs_diff,
  {O.r2('abs(abs(mean_price - median_price) / nullif(median_price, 0)) * 100')} AS abs_perc_diff FROM s)"""


@register("mean_median_gap", O.with_(*O.pipeline_ctes(O.LINEITEM_ALL, "prep"), MEAN_MEDIAN_SQL)
          + "SELECT * FROM mm", ops=("A7", "F12", "F1"))
def q_mean_median_gap(spark, sf):
    """Per item mean vs median price with absolute and % gap (round 2)."""
    return P.mean_median_gap(_train(spark, sf))


@register("mean_median_top50", O.with_(*O.pipeline_ctes(O.LINEITEM_ALL, "prep"), MEAN_MEDIAN_SQL)
          + "SELECT * FROM mm ORDER BY abs_perc_diff DESC NULLS LAST, itemID LIMIT 50",
          ops=("O1", "O2"))
def q_mean_median_top50(spark, sf):
    """The 50 items with the largest mean/median price gap."""
    from tillcast.operators.profile import top_k
    return top_k(P.mean_median_gap(_train(spark, sf)), "abs_perc_diff", 50)


@register("mean_median_gap_hot", f"""WITH prep AS (
  SELECT CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS itemID, value AS salesPrice, 'train' AS split FROM events),
{MEAN_MEDIAN_SQL}
SELECT * FROM mm""", ops=("A7",))
def q_mean_median_gap_hot(spark, sf):
    """Mean vs median price of the events fixture with a third of its lines, nearly all of different prices, on one item."""
    item = F.when(F.col("event_id") % 3 == 0, F.lit(0).cast("long")).otherwise(F.col("user_id"))
    events = spark.read.parquet(f"{sf.rstrip('/')}/events.parquet")
    return P.mean_median_gap(events.select(item.alias("itemID"), F.col("value").alias("salesPrice")))


@register("discount_extremes", O.with_(*O.pipeline_ctes(O.LINEITEM_ALL, "lines")) + """SELECT max(discountPerc) AS max_discount,
  min(discountPerc) FILTER (WHERE discountPerc IS DISTINCT FROM 0) AS min_nonzero_discount
FROM lines WHERE split = 'train'""", ops=("A21",))
def q_discount_extremes(spark, sf):
    """Largest and smallest non-zero discount share of train."""
    return P.discount_extremes(P.price_levels(_train(spark, sf)))


@register("txn_enriched_events", O.with_(*O.pipeline_ctes(O.EVENTS, "lines"), """ipc AS (
  SELECT split, itemID, count(DISTINCT salesPrice) AS item_prices_count FROM prep GROUP BY split, itemID)""")
          + f"SELECT {LINE_COLS.replace('item_prices_count', 'ipc.item_prices_count').replace('split, itemID,', 'l.split, l.itemID,', 1)} "
          "FROM lines l JOIN ipc ON l.split = ipc.split AND l.itemID = ipc.itemID",
          ops=("W1", "W2", "W4", "F2"))
def q_txn_enriched_events(spark, sf):
    """Enriched order lines of the events fixture (many prices per item and day)."""
    lines = P.prepared_transactions(_ev(spark, sf), EC)
    return P.enrich_transactions(lines).select(
        "split", "itemID", "date", "time", "order", "salesPrice", "orderValue", "maxPrice",
        "minPrice", "item_prices_count", "promotion", "discountAmount", "discountPerc")
