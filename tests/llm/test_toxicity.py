import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.tables import documents  # noqa: F401  a fixture
from tillcast.llm import toxicity as tx
from tillcast.llm.textbuf import chunks

SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def likelihood(w, t, row, col, value, grade):
    eta = np.bincount(row, w[col] * value, minlength=len(grade))
    above = np.concatenate([np.ones((len(eta), 1)), 1 / (1 + np.exp(t[None, :] - eta[:, None])), np.zeros((len(eta), 1))], 1)
    return np.log((above[:, :-1] - above[:, 1:])[np.arange(len(eta)), grade]).mean() - tx.L2 / 2 * (w ** 2).sum()


def test_fit_reaches_a_maximum_with_ordered_thresholds():
    r = np.random.default_rng(0)
    n, m = 3000, 6
    x = r.normal(size=(n, m))
    true = r.normal(size=m)
    grade = np.searchsorted([-1.0, 0.5, 2.0], x @ true + r.logistic(size=n))
    row, col = np.repeat(np.arange(n), m), np.tile(np.arange(m), n)
    w, t = tx.fit_ordinal(row, col, x.reshape(-1), grade, m)
    assert (np.diff(t) > 0).all() and np.abs(w - true).max() < 0.2 and np.abs(t - [-1.0, 0.5, 2.0]).max() < 0.2
    best = likelihood(w, t, row, col, x.reshape(-1), grade)
    for k in range(m):
        for step in (-0.1, 0.1):
            other = w.copy()
            other[k] += step
            assert likelihood(other, t, row, col, x.reshape(-1), grade) < best


def test_scores_are_the_models_expected_grade():
    text = "bad bad worse é fine"
    (chunk,) = chunks(pa.array([text, "", None]))
    _, place = tx.places(chunk)
    weights = np.zeros(tx.DIM)
    weights[place] = [2.0, 2.0, 1.0, 0.5, 0.0]
    t = np.array([1.0, 2.0, 4.0])
    eta = 2 * np.log(3) + np.log(2) * 1.5
    above = 1 / (1 + np.exp(t - eta))
    s, g, p = tx.score_chunk(chunk, weights, t)
    assert np.allclose(s, [above.sum(), *[(1 / (1 + np.exp(t))).sum()] * 2]) and np.isclose(p[0], above[0])
    assert g[0] == np.argmax(-np.diff(np.concatenate([[1], above, [0]])))


def training(spark, documents):
    rows = [(i, f"plain words number {i} and more {'vile nasty ' * (1 + i % 3) if i % 4 == 0 else ''}") for i in range(200)]
    labels = [(i, int(i % 4 == 0)) for i in range(150)]
    return rows, spark.createDataFrame(labels + [(3, None), (None, 1), (999, 1), (8, 0)], "doc_id long, toxic int")


def test_nulls_repeats_long_texts_and_clashing_columns(spark, documents):
    rows, labels = training(spark, documents)
    rows += [(500, None), (501, ""), (0, rows[0][1]), (None, "vile nasty"), (502, "calm " * 200_000 + "vile nasty")]
    df = documents([(*r, "en", "s", "kept", "replaced") for r in rows], ", scores string, toxicity string")
    got = tx.score(df, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        bad = "vile" in (r.text or "")
        assert r.toxicity.toxic == bad and (r.toxicity.severity > 0.8) == bad and 0 <= r.toxicity.grade <= 3
        assert r.scores == "kept"


def test_without_both_labels_nothing_is_toxic(spark, documents):
    df = documents([(1, "a"), (2, None)])
    for labels in ([], [(1, 1)], [(1, 0), (2, 0)]):
        got = tx.score(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
        assert [(r.toxicity.severity, r.toxicity.grade, r.toxicity.toxic) for r in got] == [(0.0, 0, False)] * 2
    assert tx.score(documents([]), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{LARGE}/documents.parquet")
    labels = spark.read.parquet(f"{LARGE}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2))
    scored = tx.score(docs, labels.where(half == 0)).join(labels.where(half == 1).withColumnRenamed("toxic", "flag"), "doc_id")
    c = {(r.flag, r.toxic): r["count"] for r in scored.groupBy("flag", F.col("toxicity.toxic").alias("toxic")).count().collect()}
    caught, missed = c.get((1, True), 0), c.get((1, False), 0)
    assert caught / max(1, caught + missed) > 0.85
    assert c.get((0, True), 0) <= 0.005 * (c.get((0, True), 0) + c[(0, False)])


def test_query_over_the_whole_table(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    got = tx.op4_toxicity(spark, SMALL)
    assert got.columns == ["doc_id", "severity", "grade", "p_toxic", "toxic"] and got.count() == rows
