"""B5/B6 item by item: a factor per item under the three limits on a whole forecast.

:mod:`inventory` scales all items by one factor. Here each item takes its own factor of a list, such that the
value of the whole is high while overstock, lost sales and locked capital stay within their limits. The
limits tie all items together; a price per unit of money of each limited total unties them again. Under given
prices an item takes, by itself, the factor with the highest gain

    gain = value - po * overstock - pl * lost sales - pc * locked capital

(the first such factor, if several are equal). Raising the price of a total never raises that total, so the
lowest price that meets a limit is found by sectioning. Many items change their choice at the same price
(a unit kept in stock is worth its price, whatever the item), so the total jumps there: from just over the
limit to far below it. Hence a limit ends with two neighbouring prices, one on either side of
the jump, and the smallest share of the items, told apart by a hash of their id, that must take the higher
one. A step is one aggregate over the items: it totals the plans of all prices or shares of the step
at once, so what comes to the driver is a row per plan.

Prices that are the same for all items also give a bound: no plan within the limits is worth more than
``sum of gains + prices * limits``. The result states the lowest one seen, which tells how far from the
best its plan can be at most.

Cases: an item without a price, forecast or demand gains nothing from any factor, takes the first one and adds
nothing to the totals; an empty table gives totals of 0.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.functions import exact_sum
from tillcast.operators.inventory import MARKUP, measures
from tillcast.session import written

#: The limited totals, in the order in which they are priced.
LIMITED = ("overstock_value", "locked_capital", "lost_value")
TOTALS = ("value", "overstock_value", "lost_value", "locked_capital")

LADDER = 8       # prices that a step totals at once
SECTIONS = 2     # steps that narrow a price, then a share, down
ROUNDS = 2       # passes over the three limits
TOP_PRICE = 64.0


#: Of a limited total: the lower price, the higher one, and the share of the items that take the higher one.
Price = tuple[float, float, float]


def flat(price: float) -> Price:
    """One price for all items."""
    return float(price), float(price), 0.0


@dataclass(frozen=True)
class Totals:
    """What a plan adds up to: its prices by limited total, or the one factor of all items."""

    prices: dict[str, Price] | None
    factor: float | None
    value: float
    limited: dict[str, float]

    def excess(self, limits: dict[str, float]) -> float:
        """The largest overrun of a limit, as a share of it (0 within all limits)."""
        return max(max(0.0, self.limited[c] - limits[c]) / max(limits[c], 1e-9) for c in LIMITED)

    def bound(self, limits: dict[str, float]) -> float:
        """No plan within the limits is worth more; infinite unless all items have the same prices."""
        if self.prices is None or any(low != high for low, high, _ in self.prices.values()):
            return float("inf")
        return self.value + sum(p * (limits[c] - self.limited[c]) for c, (p, _, _) in self.prices.items())


@dataclass(frozen=True)
class Outcome:
    """The rows of the plan (itemID, factor, units and their value), its totals, the limits as
    money, whether they are met, and the lowest bound on the value of any plan that meets them."""

    plan: DataFrame
    totals: Totals
    limits: dict[str, float]
    feasible: bool
    bound: float


def with_choices(si: DataFrame, factors) -> DataFrame:
    """Adds ``choices``: per factor its units (rounded half to even) and what they are worth."""
    def choice(factor: float) -> Column:
        units = F.rint(F.col("forecast") * F.lit(float(factor))).cast("long")
        m = measures(units, F.col("actual"), F.col("price"))
        return F.struct(F.lit(float(factor)).alias("factor"), units.alias("units"),
                        *[m[c].cast("double").alias(c) for c in TOTALS])
    return si.withColumn("choices", F.array(*[choice(f) for f in factors]))


def distinct_choices(si: DataFrame) -> DataFrame:
    """Leaves of choices of equal units the first, which is the one that is taken: a single one for an item
    without a forecast."""
    return si.withColumn("choices", F.filter("choices", lambda c, i: (i == 0) | ~c.getField("units").eqNullSafe(
        F.get("choices", i - 1).getField("units"))))


def gain(c: Column, prices: dict[str, Column]) -> Column:
    """Value of a choice less its priced totals, taken off in the order of LIMITED."""
    return reduce(lambda g, name: g - prices[name] * c.getField(name), LIMITED, c.getField("value"))


def best_choice(prices: dict[str, Column]) -> Column:
    """The choice with the highest gain, the first of equal ones."""
    rated = F.transform("choices", lambda c, i: F.struct(
        F.coalesce(gain(c, prices), F.lit(float("-inf"))).alias("gain"), (-i).alias("i")))
    return F.element_at("choices", 1 - F.array_max(rated).getField("i"))


def _own_price(k: int, low: Column, high: Column, share: Column) -> Column:
    """The price of the k-th limited total that an item takes."""
    at = F.pmod(F.xxhash64("itemID", F.lit(k)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return F.when(at < share, high).otherwise(low)


def priced_choice(choices: DataFrame, prices: dict[str, Price]) -> DataFrame:
    """itemID, factor, units, value and limited totals of every item under given prices, and its gain."""
    p = {c: _own_price(k, *(F.lit(float(x)) for x in prices[c])) for k, c in enumerate(LIMITED)}
    picked = choices.select("itemID", best_choice(p).alias("c"))
    return picked.select("itemID", "c.*", gain(F.col("c"), p).alias("gain"))


def _summed() -> list[Column]:
    """Exact totals of the column ``c`` (a choice). Locked capital comes from the stock value, as whole cents
    have exact sums and their quotients don't."""
    sums = [F.coalesce(exact_sum(F.col("c").getField(m)), F.lit(0.0)).alias(m) for m in TOTALS if m != "locked_capital"]
    stock = exact_sum(F.round(F.col("c").getField("locked_capital") * MARKUP, 6))
    return [*sums, (F.coalesce(stock, F.lit(0.0)) / MARKUP).alias("locked_capital")]


def priced_totals(choices: DataFrame, vectors: list[dict[str, Price]]) -> DataFrame:
    """One row per price vector (``vector``: its number): totals of the plan that the items choose under it."""
    rows = F.array(*[F.struct(F.lit(k).alias("vector"), *[
        F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v[c], ("low", "high", "share"))]).alias(c) for c in LIMITED])
        for k, v in enumerate(vectors)])
    each = choices.select("itemID", "choices", F.explode(rows).alias("p"))
    own = {c: _own_price(k, *(F.col(f"p.{c}.{n}") for n in ("low", "high", "share"))) for k, c in enumerate(LIMITED)}
    priced = each.select(F.col("p.vector").alias("vector"), "choices", *[x.alias(f"_{c}") for c, x in own.items()])
    picked = priced.select("vector", best_choice({c: F.col(f"_{c}") for c in LIMITED}).alias("c"))
    return picked.groupBy("vector").agg(*_summed())


def factor_totals(choices: DataFrame) -> DataFrame:
    """One row per factor that all items take alike."""
    return choices.select(F.explode("choices").alias("c")).groupBy(F.col("c.factor").alias("factor")).agg(*_summed())


def demand_value(si: DataFrame) -> DataFrame:
    """One row: the demand at its prices, of which limits are shares."""
    return si.agg(F.coalesce(exact_sum(F.col("actual") * F.col("price")), F.lit(0.0)).alias("demand_value"))


def limited_plan(si: DataFrame, factors, shares: dict[str, float], rounds: int = ROUNDS) -> Outcome:
    """The plan of highest value found within the limits, which are ``shares`` of the value of demand.

    Candidates are all plans under a price vector that the search has met and all plans of one factor, so the
    result is never worth less than the best single factor within the limits. If no
    candidate meets the limits, it is the one whose largest overrun is smallest (then the most valuable).
    """
    si = written(si.select("itemID", "forecast", "actual", "price"))
    demand = demand_value(si).first()["demand_value"]
    every = with_choices(si, factors)
    choices = written(distinct_choices(every).select("itemID", "choices"))
    limits = {c: shares[c] * demand for c in LIMITED}
    seen = [Totals(None, r["factor"], r["value"], {c: r[c] for c in LIMITED})
            for r in sorted(factor_totals(every).collect(), key=lambda r: r["factor"])]

    def totalled(vectors: list[dict[str, Price]]) -> list[Totals]:
        got = {r["vector"]: r for r in priced_totals(choices, vectors).collect()}
        found = [Totals(v, None, got[k]["value"] if k in got else 0.0,
                        {c: got[k][c] if k in got else 0.0 for c in LIMITED}) for k, v in enumerate(vectors)]
        seen.extend(found)
        return found

    def step(name: str, options: list[Price]) -> list[bool]:
        """Whether a limit is met with each option as its price."""
        return [t.limited[name] <= limits[name] for t in totalled([prices | {name: x} for x in options])]

    def narrowed(name: str, low: float, high: float, option) -> tuple[float, float]:
        """The neighbours between which the limit begins to be met; ``high`` meets it."""
        for _ in range(SECTIONS):
            inner = [low + (high - low) * k / (LADDER + 1) for k in range(1, LADDER + 1)]
            met = [x for x, ok in zip(inner, step(name, [option(x) for x in inner])) if ok]
            high = min(met, default=high)
            low = max((x for x in inner if x < high), default=low)
        return low, high

    prices = dict.fromkeys(LIMITED, flat(0.0))
    levels = [0.0, *(TOP_PRICE / 4.0 ** k for k in reversed(range(LADDER - 1)))]
    for _ in range(rounds):
        before = dict(prices)
        for name in LIMITED:
            met = [x for x, ok in zip(levels, step(name, [flat(x) for x in levels])) if ok]
            if not met or met[0] == 0.0:
                prices[name] = flat(met[0] if met else TOP_PRICE)
                continue
            low, high = narrowed(name, max(x for x in levels if x < met[0]), met[0], flat)
            share = narrowed(name, 0.0, 1.0, lambda x: (low, high, x))[1]
            prices[name] = (low, high, share)
        if prices == before:
            break
    ends = itertools.product(*[sorted({low, high}) for low, high, _ in prices.values()])
    totalled([dict(zip(LIMITED, map(flat, x))) for x in ends])  # at most 8, for the bound
    best = min(seen, key=lambda t: (t.excess(limits), -t.value))
    if best.prices is not None:
        plan = priced_choice(choices, best.prices).drop("gain")
    else:
        plan = every.select("itemID", F.explode("choices").alias("c")).where(
            F.col("c.factor") == best.factor).select("itemID", "c.*")
    return Outcome(plan, best, limits, best.excess(limits) == 0.0,
                   min(t.bound(limits) for t in seen))
