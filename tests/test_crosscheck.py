"""Our Spark operators against plain pandas / NumPy on random series."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tillcast.operators import features as X
from tillcast.operators import series as S

DAYS = 40


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(7)
    rows = []
    for item, n in ((1, DAYS), (2, DAYS), (3, 10), (4, 9)):
        vals = rng.poisson(2.0, n) * (rng.random(n) < 0.6)
        for t in range(n):
            rows.append(("train", item, dt.date(2024, 1, 1) + dt.timedelta(days=t), int(vals[t])))
    sdf = spark.createDataFrame(rows, "split string, itemID long, date date, qty_sold long")
    pdf = pd.DataFrame(rows, columns=["split", "itemID", "date", "qty_sold"])
    return sdf, pdf


def _by_key(rows, col):
    return {(r.itemID, r.date): getattr(r, col) for r in rows}


def test_rolling_previous_matches_pandas(spark, series):
    sdf, pdf = series
    got = X.add_rolling(sdf, "qty_sold", 7).collect()
    g = pdf.groupby("itemID")["qty_sold"]
    want = {"rolling_qty_sold_mean": g.transform(lambda x: x.shift(1).rolling(7).mean()),
            "rolling_qty_sold_std": g.transform(lambda x: x.shift(1).rolling(7).std()),
            "rolling_qty_sold_median": g.transform(lambda x: x.shift(1).rolling(7).median())}
    for col, w in want.items():
        have = _by_key(got, col)
        for (item, date), v in zip(zip(pdf.itemID, pdf.date), w):
            h = have[(item, date)]
            if np.isnan(v):
                assert h is None
            else:
                assert h == pytest.approx(v, abs=1e-9)


def test_lags_and_cumsum(spark, series):
    sdf, pdf = series
    got = X.add_lags(sdf, "qty_sold").withColumn("cs", X.cumulative_sum("qty_sold")).collect()
    g = pdf.groupby("itemID")["qty_sold"]
    for k in (1, 2, 3, 7):
        want = g.shift(k)
        have = _by_key(got, f"qty_sold_lag{k}")
        for key, v in zip(zip(pdf.itemID, pdf.date), want):
            assert have[key] == (None if np.isnan(v) else v)
    have = _by_key(got, "cs")
    for key, v in zip(zip(pdf.itemID, pdf.date), g.cumsum()):
        assert have[key] == v


def _np_harmonic(x, wave):
    coefs = np.fft.fft(x)
    keep = np.zeros(len(coefs), dtype=complex)
    k = wave + 1
    keep[k] = coefs[k]
    keep[-k] = coefs[-k]
    return np.fft.ifft(keep).real


def test_harmonics_match_inverse_fft(spark, series):
    sdf, pdf = series
    got = X.add_harmonics(sdf, "qty_sold", 5).collect()
    for item, grp in pdf.groupby("itemID"):
        x = grp.qty_sold.to_numpy(dtype=float)
        for i in range(5):
            if i + 1 >= len(x):
                continue
            want = _np_harmonic(x, i)
            have = _by_key(got, f"harmonic_{i}")
            for d, v in zip(grp.date, want):
                assert have[(item, d)] == pytest.approx(v, abs=1e-9)


def test_harmonic_nyquist_component(spark):
    # 10 days, component 5 = the Nyquist bin, counted once
    x = [3, 0, 1, 4, 0, 0, 2, 5, 1, 0]
    rows = [("train", 1, dt.date(2024, 1, 1) + dt.timedelta(days=t), v) for t, v in enumerate(x)]
    sdf = spark.createDataFrame(rows, "split string, itemID long, date date, qty_sold long")
    got = [r.harmonic_4 for r in X.add_harmonics(sdf, "qty_sold", 5).orderBy("date").collect()]
    assert got == pytest.approx(list(_np_harmonic(np.array(x, float), 4)), abs=1e-9)


def test_harmonic_beyond_length_is_null(spark):
    rows = [("train", 1, dt.date(2024, 1, 1) + dt.timedelta(days=t), t) for t in range(3)]
    sdf = spark.createDataFrame(rows, "split string, itemID long, date date, qty_sold long")
    got = X.add_harmonics(sdf, "qty_sold", 5).collect()
    assert all(r.harmonic_2 is None and r.harmonic_1 is not None for r in got)


def test_rolling_median_distinct(spark, series):
    sdf, pdf = series
    got = _by_key(sdf.withColumn("m", X.rolling_median_distinct("qty_sold", 7)).collect(), "m")
    for item, grp in pdf.groupby("itemID"):
        v = grp.qty_sold.tolist()
        for t, d in enumerate(grp.date):
            want = None if t < 7 else float(np.median(np.unique(v[t - 7:t])))
            assert got[(item, d)] == want


def test_exponential_smoothing_matches_pandas(spark, series):
    sdf, pdf = series
    got = _by_key(S.exponential_smoothing(sdf, 0.3).collect(), "smoothed")
    for item, grp in pdf.groupby("itemID"):
        want = grp.qty_sold.astype(float).ewm(alpha=0.3, adjust=False).mean()
        for d, v in zip(grp.date, want):
            assert got[(item, d)] == pytest.approx(v, abs=1e-9)


def test_kalman_matches_loop(spark, series):
    sdf, pdf = series
    q, r = 1.0, 10.0
    got = _by_key(S.kalman_smoothing(sdf, q, r).collect(), "kalman")
    for item, grp in pdf.groupby("itemID"):
        xs = grp.qty_sold.astype(float).tolist()
        v, p = xs[0], r - q
        for d, x in zip(grp.date, xs):
            p = p + q
            k = p / (p + r)
            v = v + k * (x - v)
            p = (1 - k) * p
            assert got[(item, d)] == pytest.approx(v, abs=1e-9)


def test_round2_equals_numpy_off_ties(spark):
    rng = np.random.default_rng(3)
    xs = [float(v) for v in rng.uniform(-1000, 1000, 2000)]
    got = [r.r for r in spark.createDataFrame([(x,) for x in xs], "x double")
           .select(__import__("tillcast.functions", fromlist=["round2"]).round2("x").alias("r"))
           .collect()]
    assert got == [float(np.round(x, 2)) for x in xs]


def test_outliers_and_normalise(spark, series):
    sdf, pdf = series
    got = S.normalise(S.outlier_flags(sdf)).collect()
    for item, grp in pdf.groupby("itemID"):
        x = grp.qty_sold.astype(float)
        z = (x - x.mean()) / x.std()
        q1, q3 = x.quantile(0.25), x.quantile(0.75)
        iqr = (x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1))
        have_z = _by_key(got, "z_score")
        have_iqr = _by_key(got, "iqr_outlier")
        have_mm = _by_key(got, "qty_sold_minmax")
        for d, zz, ii, xx in zip(grp.date, z, iqr, x):
            assert have_z[(item, d)] == pytest.approx(zz, abs=1e-9)
            assert have_iqr[(item, d)] == bool(ii)
            assert have_mm[(item, d)] == pytest.approx((xx - x.min()) / (x.max() - x.min()))
