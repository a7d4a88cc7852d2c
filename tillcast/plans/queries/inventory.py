"""Monetary value of a forecast, limits, scenario sweep, submission."""

from __future__ import annotations

from tillcast.operators import inventory as B
from tillcast.operators import stock_plan as SP
from tillcast.plans import features as E1
from tillcast.plans import oracle as O
from tillcast.plans.registry import register
from tillcast.sources import fixtures as FX
from tillcast.sources.files import submission
from tillcast.plans.queries.common import (
    LC, _li)


# --- inventory value (J8, B1-B6, S6) -----------------------------------------------------------

#: Shares of the value of the demand, so a verdict doesn't depend on the amount of data.
LIMITS = dict(max_overstock=0.5, max_lost=0.95, max_locked=0.5)
#: Tighter shares, which no single factor meets.
PLAN_LIMITS = {"overstock_value": 0.02, "locked_capital": 0.06, "lost_value": 0.94}
#: Given prices of the limited totals, in the order in which they are taken off.
PRICES = {"overstock_value": 0.5, "locked_capital": 0.25, "lost_value": 0.125}


FACTORS = [round(0.1 * i, 1) for i in range(21)]


def _score_input(spark, sf):
    daily = E1.daily_table(_li(spark, sf), LC)
    return B.score_input(FX.items(spark, sf), B.naive_forecast(daily, LC),
                         B.actual_demand(daily, LC), FX.infos(spark, sf))


SCORE_SQL = f"""fc AS (SELECT itemID, CAST(sum(qty_sold) AS BIGINT) AS forecast FROM daily
  WHERE date BETWEEN {O.d(LC.split_date)} - INTERVAL {LC.horizon - 1} DAY AND {O.d(LC.split_date)} GROUP BY itemID),
ac AS (SELECT itemID, CAST(sum(qty_sold) AS BIGINT) AS actual FROM daily
  WHERE date BETWEEN {O.d(LC.test_start)} AND {O.d(LC.score_end)} GROUP BY itemID),
si AS (SELECT i.itemID, coalesce(fc.forecast, 0) AS forecast, coalesce(ac.actual, 0) AS actual,
         f.simulationPrice AS price
  FROM items_v i LEFT JOIN fc ON i.itemID = fc.itemID LEFT JOIN ac ON i.itemID = ac.itemID
  LEFT JOIN infos_v f ON i.itemID = f.itemID)"""


def value_sql(src: str, f: str) -> str:
    return f"""SELECT *,
  CASE WHEN {f} <= actual THEN price * {f} ELSE price * actual - CAST(0.6 AS DOUBLE) * price * ({f} - actual) END AS value,
  CAST(greatest({f} - actual, 0) AS BIGINT) AS overstock_units, greatest({f} - actual, 0) * price AS overstock_value,
  CAST(greatest(actual - {f}, 0) AS BIGINT) AS lost_units, greatest(actual - {f}, 0) * price AS lost_value,
  {f} * price AS stock_value, {f} * price / CAST(1.3 AS DOUBLE) AS locked_capital
FROM {src}"""


TOTALS_SQL = f"""sum(value) AS total_value, CAST(sum(overstock_units) AS BIGINT) AS overstock_units,
  sum(overstock_value) AS overstock_value, CAST(sum(lost_units) AS BIGINT) AS lost_units,
  sum(lost_value) AS lost_value, {O.r2('sum(stock_value)')} / CAST(1.3 AS DOUBLE) AS locked_capital"""


TOTAL_FUZZ = ("total_value", ("overstock_value", 2), ("lost_value", 2), "locked_capital")


VALUE_CTES = O.pipeline_ctes(O.LINEITEM, "daily") + [SCORE_SQL]


@register("forecast_value", O.with_(*VALUE_CTES) + value_sql("si", "forecast"),
          ops=("J8", "B1", "B2", "B3", "B4", "T6"))
def q_forecast_value(spark, sf):
    """Per item value, overstock, lost sales and locked capital of a naive
    last-14-days forecast against the first 14 test days."""
    return B.monetary_value(_score_input(spark, sf))


@register("forecast_value_totals", O.with_(*VALUE_CTES, f"v AS ({value_sql('si', 'forecast')})")
          + f"SELECT {TOTALS_SQL} FROM v", fuzz=TOTAL_FUZZ, ops=("B1", "B2", "B3", "B4"))
def q_forecast_value_totals(spark, sf):
    """Totals of value, overstock, lost sales and locked capital."""
    return B.value_totals(B.monetary_value(_score_input(spark, sf)))


def _limits_sql(src="t"):
    def ok(col: str, limit: str) -> str:
        return f"{col} <= {O.dbl(LIMITS[limit])} * (SELECT {O.xsum('actual * price')} FROM si)"
    o, l, c = ok("overstock_value", "max_overstock"), ok("lost_value", "max_lost"), ok("locked_capital", "max_locked")
    return f"SELECT *, {o} AS overstock_ok, {l} AS lost_ok, {c} AS capital_ok, {o} AND {l} AND {c} AS feasible FROM {src}"


@register("constraint_check", O.with_(*VALUE_CTES, f"v AS ({value_sql('si', 'forecast')})",
                                      f"t AS (SELECT {TOTALS_SQL} FROM v)") + _limits_sql(),
          fuzz=TOTAL_FUZZ, ops=("B5",))
def q_constraint_check(spark, sf):
    """Totals checked against limits (shares of the demand's value) on the retailer's overstock, lost sales and capital."""
    si = _score_input(spark, sf)
    return B.constraint_check(B.value_totals(B.monetary_value(si)), **B.demand_shares(si, **LIMITS))


_FACTOR_VALUES = ", ".join(f"({O.dbl(float(x))})" for x in FACTORS)


@register("scenario_sweep", O.with_(*VALUE_CTES, f"""sc AS (
  SELECT si.*, fct.factor, CAST(round_even(si.forecast * fct.factor, 0) AS BIGINT) AS scaled
  FROM si, (VALUES {_FACTOR_VALUES}) fct(factor))""", f"v AS ({value_sql('sc', 'scaled')})",
                                    f"t AS (SELECT factor, {TOTALS_SQL} FROM v GROUP BY factor)",
                                    f"c AS ({_limits_sql()})")
          + """SELECT *, feasible AND row_number() OVER (PARTITION BY feasible ORDER BY total_value DESC, factor) = 1 AS best
FROM c""", fuzz=TOTAL_FUZZ, ops=("B6",))
def q_scenario_sweep(spark, sf):
    """Forecast scaled by 0.0..2.0: totals, feasibility under the limits, best factor."""
    si = _score_input(spark, sf)
    return B.scenario_sweep(si, FACTORS, **B.demand_shares(si, **LIMITS))


def _gain_sql(prices: dict[str, str]) -> str:
    return "value" + "".join(f" - {prices[c]} * {c}" for c in SP.LIMITED)


SCALED_SQL = f"""sc AS (
  SELECT si.*, fct.factor, CAST(round_even(si.forecast * fct.factor, 0) AS BIGINT) AS units
  FROM si, (VALUES {_FACTOR_VALUES}) fct(factor))"""


@register("priced_choice", O.with_(*VALUE_CTES, SCALED_SQL, f"v AS ({value_sql('sc', 'units')})",
                                   f"g AS (SELECT *, {_gain_sql({c: O.dbl(p) for c, p in PRICES.items()})} AS gain FROM v)")
          + """SELECT itemID, factor, units, value, overstock_value, lost_value, locked_capital, gain FROM g
QUALIFY row_number() OVER (PARTITION BY itemID ORDER BY gain DESC NULLS LAST, factor) = 1""",
          fuzz=("value", "overstock_value", "lost_value", "locked_capital", "gain"), ops=("B5", "B6"))
def q_priced_choice(spark, sf):
    """The factor that each item takes by itself when overstock, lost sales and locked capital have given prices."""
    return SP.priced_choice(SP.with_choices(_score_input(spark, sf), FACTORS), {c: SP.flat(p) for c, p in PRICES.items()})


#: Prices of the registered totals: none, the given ones, and each of them alone.
VECTORS = [dict.fromkeys(PRICES, 0.0), PRICES, *({**dict.fromkeys(PRICES, 0.0), c: PRICES[c]} for c in PRICES)]
_VECTOR_VALUES = ", ".join(f"({k}, {', '.join(O.dbl(v[c]) for c in SP.LIMITED)})" for k, v in enumerate(VECTORS))


@register("priced_totals", O.with_(*VALUE_CTES, SCALED_SQL, f"v AS ({value_sql('sc', 'units')})", f"""g AS (
  SELECT v.*, pv.vector, {_gain_sql({c: f"pv.p_{c}" for c in SP.LIMITED})} AS gain
  FROM v, (VALUES {_VECTOR_VALUES}) pv(vector, {', '.join(f'p_{c}' for c in SP.LIMITED)})
  QUALIFY row_number() OVER (PARTITION BY pv.vector, itemID ORDER BY gain DESC NULLS LAST, factor) = 1)""")
          + f"""SELECT vector, {O.xsum('value')} AS value, {O.xsum('overstock_value')} AS overstock_value, {O.xsum('lost_value')} AS lost_value,
  {O.xsum('stock_value')} / CAST(1.3 AS DOUBLE) AS locked_capital FROM g GROUP BY vector""",
          fuzz=tuple(SP.TOTALS), ops=("B5", "B6"))
def q_priced_totals(spark, sf):
    """Totals of the items' own choices under several price vectors, in one aggregate."""
    choices = SP.distinct_choices(SP.with_choices(_score_input(spark, sf), FACTORS))
    return SP.priced_totals(choices, [{c: SP.flat(p) for c, p in v.items()} for v in VECTORS])


@register("limited_forecast", None, ops=("B5", "B6"))
def q_limited_forecast(spark, sf):
    """The forecast of every item, scaled by a factor of its own so that all three limits on the whole hold
    and its value is high; whether they hold, its total value and the bound on any plan's."""
    from pyspark.sql import functions as F
    found = SP.limited_plan(_score_input(spark, sf), FACTORS, PLAN_LIMITS)
    return found.plan.withColumns({"feasible": F.lit(found.feasible), "total_value": F.lit(found.totals.value),
                                   "bound": F.lit(found.bound)})


@register("submission", O.with_(*VALUE_CTES)
          + "SELECT itemID, CAST(greatest(0, round_even(forecast, 0)) AS INT) AS demandPrediction FROM si",
          ops=("S6", "M11"))
def q_submission(spark, sf):
    """Submission content (itemID, demandPrediction) of the naive forecast."""
    return submission(_score_input(spark, sf).withColumnRenamed("forecast", "demandPrediction"))
