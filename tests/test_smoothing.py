"""Backward smoothing, one-pass harmonics and exact medians against NumPy."""

import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from tillcast.operators import features as X
from tillcast.operators import prepare as P
from tillcast.operators import series as S


def _grid(spark, series):
    rows = [("train", item, dt.date(2024, 1, 1) + dt.timedelta(days=k), None if v is None else int(v))
            for item, x in series.items() for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "split string, itemID long, date date, qty_sold long")


def _smoother(x, q, r):
    v, p, loglik, level, var = x[0], r - q, 0.0, [], []
    for value in x:
        ahead = p + q
        loglik -= 0.5 * (math.log(ahead + r) + (value - v) ** 2 / (ahead + r))
        gain = ahead / (ahead + r)
        v, p = v + gain * (value - v), (1 - gain) * ahead
        level.append(v)
        var.append(p)
    s = [level[-1]]
    for t in range(len(x) - 2, -1, -1):
        s.append(level[t] + var[t] / (var[t] + q) * (s[-1] - level[t]))
    return loglik, level, s[::-1]


def test_smoother_against_numpy(spark):
    rng = np.random.default_rng(4)
    series = {1: rng.poisson(5, 50).astype(float), 2: np.repeat([0.0, 20.0, 3.0], 20), 3: np.array([7.0]), 4: np.zeros(12),
              5: np.cumsum(rng.normal(0, 3, 90)).round()}
    got = {}
    for row in S.kalman_smoother(_grid(spark, series)).collect():
        got.setdefault(row["itemID"], []).append(row)
    chosen = set()
    for item, x in series.items():
        rows = sorted(got[item], key=lambda r: r["date"])
        best = max(S.VARIANCES, key=lambda c: _smoother(x, *c)[0])
        assert {(r["q"], r["r"]) for r in rows} == {best}
        _, level, smooth = _smoother(x, *best)
        assert np.allclose([r["kalman"] for r in rows], level) and np.allclose([r["smoothed"] for r in rows], smooth)
        chosen.add(best)
    assert len(chosen) > 2


def test_smoother_uses_later_days(spark):
    x = [0.0] * 20 + [10.0] * 20
    rows = sorted(S.kalman_smoother(_grid(spark, {1: x}), variances=[(1.0, 10.0)]).collect(), key=lambda r: r["date"])
    assert rows[19]["kalman"] == 0.0 and 1.0 < rows[19]["smoothed"] < 9.0
    assert S.kalman_smoother(_grid(spark, {})).count() == 0


def _fourier(x, n):
    f = np.fft.rfft(x)
    f[n + 1:] = 0
    return np.fft.irfft(f, len(x))


def test_harmonics_in_one_pass(spark):
    rng = np.random.default_rng(5)
    series = {1: rng.poisson(4, 60), 2: rng.poisson(9, 20), 3: rng.poisson(2, 21), 4: rng.poisson(3, 10), 5: np.zeros(30), 6: [4]}
    df = _grid(spark, series).withColumn("other", F.col("itemID") * 2)
    out = X.harmonic_smoothing(df, "qty_sold", 10)
    assert out.columns == [*df.columns, "harmonic_smooth"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1
    for item, x in series.items():
        rows = sorted(out.where(f"itemID = {item}").collect(), key=lambda r: r["date"])
        assert [r["qty_sold"] for r in rows] == list(x) and {r["other"] for r in rows} == {2 * item}
        if len(x) <= 10:
            assert all(r["harmonic_smooth"] is None for r in rows)
        else:
            assert np.allclose([r["harmonic_smooth"] for r in rows], _fourier(np.array(x, float), 10), atol=1e-9)


def test_harmonics_of_a_long_series_stay_exact(spark):
    x = np.random.default_rng(6).poisson(20, 2500)
    rows = sorted(X.harmonic_smoothing(_grid(spark, {1: x}), "qty_sold", 10).collect(), key=lambda r: r["date"])
    assert np.allclose([r["harmonic_smooth"] for r in rows], _fourier(x.astype(float), 10), atol=1e-7)


def test_exact_median_of_hot_and_cold_items(spark):
    rng = np.random.default_rng(7)
    prices = {1: np.round(rng.lognormal(3, 2, 20001), 6), 2: [5.0, 1.0], 3: [2.0] * 7, 4: [1.0, 1.0, 9.0, 9.0], 5: [3.5], 6: []}
    rows = [(k, float(v)) for k, x in prices.items() for v in x] + [(6, None), (2, None)]
    txn = spark.createDataFrame(rows, "itemID long, salesPrice double")
    levels = txn.groupBy("itemID", "salesPrice").agg(F.count("*").alias("n"))
    out = P.exact_median(levels, "itemID", "salesPrice", "n")
    assert "percentile(" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["itemID"]: r["median"] for r in out.collect()}
    assert got == {k: float(np.median(x)) for k, x in prices.items() if len(x)}
    gap = {r["itemID"]: r for r in P.mean_median_gap(txn).collect()}
    assert gap[6]["median_price"] is None and gap[6]["mean_price"] is None and len(gap) == 6


def _smoothed(x, a):
    v, error, levels, ahead = None, 0.0, [], []
    for value in x:
        before = value if v is None else v
        now = before if value is None else value
        if now is not None:
            error += (now - before) ** 2
            v = a * now + (1 - a) * before
        levels.append(v)
        ahead.append(before)
    return error, levels, ahead


def test_smoothing_parameter_per_item(spark):
    rng = np.random.default_rng(9)
    series = {1: list(rng.poisson(5, 60)), 2: list(np.cumsum(rng.integers(-3, 6, 60))), 3: [7], 4: [0] * 12,
              5: [None, None, 4, None, 9, 9, None, 8], 6: [None, None], 7: [0] * 20 + [30] * 20}
    got, chosen = {}, {}
    for row in S.fitted_smoothing(_grid(spark, series)).collect():
        got.setdefault(row["itemID"], []).append(row)
    for item, x in series.items():
        rows = sorted(got[item], key=lambda r: r["date"])
        best = min(S.ALPHAS, key=lambda a: _smoothed(x, a)[0])
        error, levels, ahead = _smoothed(x, best)
        assert {r["alpha"] for r in rows} == {best} and abs(rows[0]["squared_error"] - error) < 1e-6
        for have, want in (("smoothed", levels), ("ahead", ahead)):
            assert all((r[have] is None) == (w is None) and (w is None or abs(r[have] - w) < 1e-9) for r, w in zip(rows, want))
        chosen[item] = best
    assert chosen[1] < chosen[2] and chosen[4] == S.ALPHAS[0]
    assert S.fitted_smoothing(_grid(spark, {})).count() == 0
