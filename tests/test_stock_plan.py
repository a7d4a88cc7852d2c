"""A factor per item under limits: against enumeration, and never below the best single factor."""

import itertools

import numpy as np

from tillcast.operators import inventory as B
from tillcast.operators import stock_plan as SP

FACTORS = [0.0, 0.5, 1.0, 1.5]
SCHEMA = "itemID long, forecast long, actual long, price double"


def _rows(seed, n):
    rng = np.random.default_rng(seed)
    return [(k, int(f), int(a), float(p)) for k, (f, a, p) in enumerate(zip(
        rng.poisson(6, n), rng.poisson(6, n), np.round(rng.lognormal(2, 1, n), 2)))]


def _choice(row, factor):
    _, f, a, p = row
    u = int(np.rint(f * factor))
    value = p * u if u <= a else p * a - 0.6 * p * (u - a)
    return u, value, {"overstock_value": max(u - a, 0) * p, "lost_value": max(a - u, 0) * p, "locked_capital": u * p / 1.3}


def _enumerated(rows, limits):
    """The best value of any plan within the limits."""
    best = None
    for plan in itertools.product(FACTORS, repeat=len(rows)):
        picked = [_choice(r, f) for r, f in zip(rows, plan)]
        if all(sum(m[c] for _, _, m in picked) <= limits[c] + 1e-9 for c in limits):
            best = max(sum(v for _, v, _ in picked), -1e18 if best is None else best)
    return best


def test_choice_under_given_prices(spark):
    rows = _rows(1, 200)
    prices = {"overstock_value": 0.5, "locked_capital": 0.9, "lost_value": 0.25}
    choices, flat = SP.with_choices(spark.createDataFrame(rows, SCHEMA), FACTORS), {c: SP.flat(p) for c, p in prices.items()}
    got = {r["itemID"]: r for r in SP.priced_choice(choices, flat).collect()}
    total = 0.0
    for row in rows:
        gains = []
        for f in FACTORS:
            _, v, m = _choice(row, f)
            for c in SP.LIMITED:
                v -= prices[c] * m[c]
            gains.append(v)
        k = int(np.argmax(gains))
        assert got[row[0]]["factor"] == FACTORS[k] and got[row[0]]["units"] == _choice(row, FACTORS[k])[0]
        total += _choice(row, FACTORS[k])[1]
    for of in (choices, SP.distinct_choices(choices)):
        (sums,) = SP.priced_totals(of, [flat]).collect()
        assert abs(sums["value"] - total) < 1e-6


def test_a_higher_price_never_raises_its_total(spark):
    choices = SP.with_choices(spark.createDataFrame(_rows(2, 300), SCHEMA), FACTORS)
    for name in SP.LIMITED:
        steps = [SP.flat(0.0), SP.flat(0.25), (0.25, 1.0, 0.3), (0.25, 1.0, 0.8), SP.flat(1.0), SP.flat(2.0)]
        ladder = [dict.fromkeys(SP.LIMITED, SP.flat(0.125)) | {name: x} for x in steps]
        totals = [r[name] for r in SP.priced_totals(choices, ladder).orderBy("vector").collect()]
        assert all(a >= b for a, b in zip(totals, totals[1:])) and totals[0] > totals[-1]


def test_plan_against_enumeration_and_bound(spark):
    for seed, shares in ((3, (0.3, 0.6, 0.9)), (4, (0.05, 0.5, 0.7)), (5, (0.5, 0.4, 0.9))):
        rows = _rows(seed, 7)
        shares = dict(zip(SP.LIMITED, shares))
        got = SP.limited_plan(spark.createDataFrame(rows, SCHEMA), FACTORS, shares)
        best = _enumerated(rows, got.limits)
        units = {r["itemID"]: r["factor"] for r in got.plan.collect()}
        picked = [_choice(r, units[r[0]]) for r in rows]
        assert abs(sum(v for _, v, _ in picked) - got.totals.value) < 1e-6
        if best is None:
            assert not got.feasible
            continue
        assert got.bound >= best - 1e-6  # holds whether or not a plan was found
        if got.feasible:
            assert all(sum(m[c] for _, _, m in picked) <= got.limits[c] + 1e-6 for c in SP.LIMITED)
            assert got.totals.value <= best + 1e-6


def test_many_items_come_close_to_the_bound(spark):
    rows = _rows(6, 400)
    si = spark.createDataFrame(rows, SCHEMA)
    got = SP.limited_plan(si, FACTORS, {"overstock_value": 0.02, "locked_capital": 0.55, "lost_value": 0.45})
    assert got.feasible and got.totals.prices is not None
    assert got.bound * 0.97 <= got.totals.value <= got.bound + 1e-6
    limits = {k: got.limits[c] for k, c in (("max_overstock", "overstock_value"), ("max_lost", "lost_value"), ("max_locked", "locked_capital"))}
    sweep = B.scenario_sweep(si, FACTORS, **limits).where("best").collect()
    assert all(got.totals.value >= r["total_value"] for r in sweep)


def test_limits_that_cannot_be_met_and_empty_or_odd_items(spark):
    si = spark.createDataFrame([(1, 10, 10, 2.0), (2, 0, 5, 1.0), (3, 4, 4, None), (4, 5, 0, 3.0)], SCHEMA)
    none = SP.limited_plan(si, FACTORS, {"overstock_value": 0.0, "locked_capital": 0.1, "lost_value": 0.1})
    assert not none.feasible and none.plan.count() == 4
    free = SP.limited_plan(si, FACTORS, {"overstock_value": 9.0, "locked_capital": 9.0, "lost_value": 9.0})
    got = {r["itemID"]: (r["factor"], r["units"]) for r in free.plan.collect()}
    assert free.feasible and got == {1: (1.0, 10), 2: (0.0, 0), 3: (0.0, 0), 4: (0.0, 0)}
    assert free.totals.value == free.bound == 20.0
    empty = SP.limited_plan(spark.createDataFrame([], SCHEMA), FACTORS, dict.fromkeys(SP.LIMITED, 0.5))
    assert empty.plan.count() == 0 and empty.totals.value == 0.0
