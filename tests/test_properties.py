"""Property checks with hypothesis: rounding against NumPy, exact sums, monetary value bounds."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tillcast.functions import exact_sum, round_half_even
from tillcast.operators import inventory as B

finite = st.floats(min_value=-1e15, max_value=1e15, allow_nan=False, allow_infinity=False)
cents = st.integers(min_value=-10**13, max_value=10**13).map(lambda n: n / 1000)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(finite, cents), min_size=50, max_size=300))
def test_rounding_is_numpys_at_every_magnitude(spark, xs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i long, x double")
    got = {r.i: (r.a, r.b) for r in df.select(
        "i", round_half_even("x", 2).alias("a"), round_half_even("x", 6).alias("b")).collect()}
    for i, x in enumerate(xs):
        assert got[i] == (np.rint(x * 100) / 100, np.rint(x * 1e6) / 1e6), x


def test_rounding_of_three_decimals_is_numpys(spark):
    import pandas as pd

    xs = np.concatenate([np.random.default_rng(5).integers(0, 10**7, 99_990) / 1000,
                         [1.015, 8.345, 0.125, 845.615, 1e9 + 0.005, 2e9 + 0.125, 1e12 + 0.375, -2.675, 0.0, 1e-9]])
    got = spark.createDataFrame(pd.DataFrame({"x": xs})).select("x", round_half_even("x", 2).alias("r")).toPandas()
    assert (got["r"].to_numpy() == np.round(got["x"].to_numpy(), 2)).all()


def test_exact_sums_do_not_depend_on_order(spark):
    xs = [845.61, 845.62, 0.1, 0.2, 0.3, 1e9 + 0.01, 1e-6] * 300
    sums = {spark.createDataFrame([(x,) for x in order], "x double").repartition(n).select(exact_sum("x")).first()[0]
            for order, n in ((xs, 1), (xs[::-1], 3), (sorted(xs), 7))}
    assert len(sums) == 1


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 50),
                          st.integers(1, 100000).map(lambda c: c / 100)),
                min_size=1, max_size=100))
def test_value_bounds(spark, rows):
    si = spark.createDataFrame([(i, f, a, p) for i, (f, a, p) in enumerate(rows)],
                               "itemID long, forecast long, actual long, price double")
    for r in B.monetary_value(si).collect():
        assert r.value <= r.price * r.actual + 1e-9                 # never above perfect sales
        assert r.overstock_units * r.lost_units == 0                # not both at once
        if r.forecast <= r.actual:
            assert abs(r.value - r.price * r.forecast) < 1e-9
