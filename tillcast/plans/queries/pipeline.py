"""E1 queries: daily table, dense grid, feature table."""

from __future__ import annotations

from tillcast.plans import features as E1
from tillcast.plans import oracle as O
from tillcast.plans.registry import register
from tillcast.sources import fixtures as FX
from tillcast.plans.queries.common import (
    EC, FEATURE_FUZZ, LC, _ev, _li)


# --- E1: daily table, grid, feature table --------------------------------------------

DAILY_COLS = ("split, date, itemID, qty_sold, sales_value, promotion, maxItemPrice, "
              "minItemPrice, PricePerEachToday, Price, PriceToday, medianDiscPerc")


@register("daily_sales", O.with_(*O.pipeline_ctes(O.LINEITEM, "daily"))
          + f"SELECT {DAILY_COLS} FROM daily",
          fuzz=(("sales_value", 2), "PriceToday"),
          ops=("P1", "P2", "P3", "P4", "P5", "W1", "W2", "A1", "A2", "W5", "A6", "P14", "J1", "F1"))
def q_daily_sales(spark, sf):
    """Daily sold table of both splits (price basis: mean line price)."""
    return E1.daily_table(_li(spark, sf), LC)


@register("daily_sales_revenue", O.with_(*O.pipeline_ctes(O.LINEITEM, "daily", "revenue"))
          + f"SELECT {DAILY_COLS} FROM daily",
          fuzz=(("sales_value", 2), "PriceToday"), ops=("A1", "W5"))
def q_daily_sales_revenue(spark, sf):
    """Daily sold table, revenue basis for Price / PriceToday."""
    return E1.daily_table(_li(spark, sf), LC, price_basis="revenue")


@register("daily_sales_events", O.with_(*O.pipeline_ctes(O.EVENTS, "daily"))
          + f"SELECT {DAILY_COLS} FROM daily",
          fuzz=(("sales_value", 2), "PriceToday"), ops=("A1", "A2", "W1", "W5"))
def q_daily_sales_events(spark, sf):
    """Daily table over the dense events fixture (several prices per day)."""
    return E1.daily_table(_ev(spark, sf), EC)


@register("dense_grid", O.with_(*O.pipeline_ctes(O.LINEITEM, "grid"))
          + f"SELECT {DAILY_COLS} FROM grid",
          fuzz=(("sales_value", 2),), ops=("T1", "T2", "J2", "J3", "W14", "W15", "P15"))
def q_dense_grid(spark, sf):
    """Gap-free date x item table of both splits."""
    return E1.grid_table(_li(spark, sf), LC)


@register("dense_grid_events", O.with_(*O.pipeline_ctes(O.EVENTS, "grid"))
          + f"SELECT {DAILY_COLS} FROM grid",
          fuzz=(("sales_value", 2),), ops=("T1", "T2", "W14", "W15"))
def q_dense_grid_events(spark, sf):
    """Gap-free grid over the events fixture."""
    return E1.grid_table(_ev(spark, sf), EC)


@register("feature_table", O.with_(*O.pipeline_ctes(O.LINEITEM, "feat"))
          + f"SELECT {O.FEATURE_SELECT} FROM feat",
          fuzz=FEATURE_FUZZ,
          ops=("E1", "J1", "F6", "F8", "T3", "T5", "W6", "W7", "W8", "W11", "P7", "P8", "P13"))
def q_feature_table(spark, sf):
    """The feature table (train.csv + test.csv) over the lineitem fixture."""
    return E1.feature_table(_li(spark, sf), FX.items(spark, sf), LC)


@register("feature_table_revenue", O.with_(*O.pipeline_ctes(O.LINEITEM, "feat", "revenue"))
          + f"SELECT {O.FEATURE_SELECT} FROM feat", fuzz=(*FEATURE_FUZZ, ("PriceToday", 2)), ops=("E1", "A1", "W5"))
def q_feature_table_revenue(spark, sf):
    """The feature table on the revenue basis for Price and PriceToday."""
    return E1.feature_table(_li(spark, sf), FX.items(spark, sf), LC, price_basis="revenue")


@register("feature_table_events", O.with_(*O.pipeline_ctes(O.EVENTS, "feat"))
          + f"SELECT {O.FEATURE_SELECT} FROM feat",
          fuzz=FEATURE_FUZZ, ops=("E1", "T3", "W6", "W7", "W8"))
def q_feature_table_events(spark, sf):
    """The feature table over the events fixture."""
    return E1.feature_table(_ev(spark, sf), FX.event_items(spark, sf), EC)
