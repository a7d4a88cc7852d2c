"""Second-order trees and category encodings against plain NumPy and hand-made cases."""

import numpy as np
from pyspark.sql import functions as F

from tillcast.operators import boosting as T
from tillcast.operators import categories as C


def _brute(x, y, depth, base, lam=1.0):
    """Cuts by node: every value of every feature, missing values on either side."""
    g, node, cuts = base - y, np.ones(len(y), int), {}
    for level in range(depth):
        for k in range(1 << level, 2 << level):
            mine = node == k
            best = None
            for f in range(x.shape[1]):
                v = x[mine, f]
                for cut in np.unique(v[~np.isnan(v)]):
                    for missing_left in (False, True):
                        left = (v <= cut) | (np.isnan(v) & missing_left)
                        if left.all() or not left.any():
                            continue
                        gl, gr = g[mine][left].sum(), g[mine][~left].sum()
                        hl, hr = left.sum(), (~left).sum()
                        gain = (gl ** 2 / (hl + lam) + gr ** 2 / (hr + lam) - (gl + gr) ** 2 / (hl + hr + lam)) / 2
                        if gain > 1e-9 and (best is None or gain > best[3] + 1e-9):
                            best = (f, cut, missing_left, gain)
            if best:
                cuts[k] = best
                f, cut, missing_left, _ = best
                left = (x[:, f] <= cut) | (np.isnan(x[:, f]) & missing_left)
                node = np.where(mine, 2 * node + ~left, node)
    weight = {k: -g[node == k].sum() / ((node == k).sum() + lam) for k in set(node.tolist())}
    return cuts, node, weight


def _data(spark, seed=1, n=400):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 6, (n, 3)).astype(float)
    x[rng.random((n, 3)) < 0.25] = np.nan
    y = np.round(3 * np.isnan(x[:, 0]) + np.nan_to_num(x[:, 1]) ** 2 + rng.integers(0, 3, n))
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "id long, a double, b double, c double, y double")


def test_one_tree_equals_brute_force(spark):
    x, y, df = _data(spark)
    model = T.fit(df, ["a", "b", "c"], "y", rounds=1, depth=3, rate=0.3)
    cuts, node, weight = _brute(x, y, 3, model.base)
    got = model.trees[0].cuts
    assert {k: (f, c, m) for k, (f, c, m, _) in got.items()} == {k: (f, c, m) for k, (f, c, m, _) in cuts.items()}
    assert all(abs(got[k][3] - cuts[k][3]) < 1e-6 for k in cuts)
    pred = {r["id"]: r["prediction"] for r in model.predict(df).collect()}
    assert all(abs(pred[i] - (model.base + 0.3 * weight[k])) < 1e-6 for i, k in enumerate(node.tolist()))


def test_missing_values_take_the_learned_side(spark):
    df = spark.createDataFrame([(1.0, 0.0)] * 10 + [(2.0, 9.0)] * 10 + [(None, 9.0)] * 5, "x double, y double")
    high = T.fit(df, ["x"], "y", rounds=1, depth=1)
    assert high.trees[0].cuts[1][:3] == (0, 1.0, False)
    low = T.fit(df.withColumn("y", F.when(F.col("x").isNull(), 0.0).otherwise(F.col("y"))), ["x"], "y", rounds=1, depth=1)
    assert low.trees[0].cuts[1][:3] == (0, 1.0, True)
    # a feature that is only present or missing is cut between the two
    only = T.fit(df.withColumn("x", F.when(F.col("x").isNotNull(), 1.0)), ["x"], "y", rounds=1, depth=1)
    assert only.trees[0].cuts[1][:3] == (0, 1.0, False)


def test_fit_does_not_depend_on_partitions_and_lowers_the_error(spark):
    x, y, df = _data(spark, 2, 600)
    one = T.fit(df.coalesce(1), ["a", "b", "c"], "y", rounds=7, depth=3)
    many = T.fit(df.repartition(9), ["a", "b", "c"], "y", rounds=7, depth=3)
    assert one.table(spark).collect() == many.table(spark).collect()
    error = [one.predict(df).select(F.avg((F.col("prediction") - F.col("y")) ** 2)).first()[0]]
    one.trees = one.trees[:3]
    error.append(one.predict(df).select(F.avg((F.col("prediction") - F.col("y")) ** 2)).first()[0])
    assert error[0] < error[1] < float(np.var(y))
    names = [r["feature"] for r in many.importance(spark).collect()]
    assert sorted(names) == ["a", "b", "c"]


def test_cases_without_cuts(spark):
    empty = spark.createDataFrame([], "x double, y double")
    assert T.fit(empty, ["x"], "y").trees == []
    constant = spark.createDataFrame([(float(i), 2.0) for i in range(9)] + [(1.0, None)], "x double, y double")
    model = T.fit(constant, ["x"], "y")
    assert model.trees == [] and model.predict(constant).select("prediction").distinct().collect()[0][0] == 2.0
    nulls = spark.createDataFrame([(None, float(i)) for i in range(9)], "x double, y double")
    assert T.fit(nulls, ["x"], "y").trees == []


def test_bins_of_many_values(spark):
    df = spark.range(3000).select(F.col("id").cast("double").alias("x"), (F.col("id") > 1800).cast("double").alias("y"))
    cuts = T.cut_points(df, ["x"], 64)["x"]
    assert len(cuts) <= 64 and cuts == sorted(set(cuts))
    got = df.select("x", T.bin_of(F.col("x"), cuts).alias("bin")).collect()
    assert all(r["bin"] == sum(c < r["x"] for c in cuts) for r in got)
    model = T.fit(df, ["x"], "y", rounds=1, depth=1, bins=64)
    assert abs(model.trees[0].cuts[1][1] - 1800) <= 3000 / 64


def test_a_million_categories(spark):
    n = 1_000_000
    wide = spark.range(2 * n).select(F.concat(F.lit("c"), F.col("id") % n).alias("value"), (F.col("id") % 1000).alias("label"))
    hot = spark.range(n).select(F.lit("hot").alias("value"), F.lit(5000).cast("long").alias("label"))
    df = wide.union(hot)
    order = C.category_order(df, ["value"], "label")
    assert order.agg(F.count("*"), F.min("position"), F.max("position"), F.count_distinct("position")).first()[:] == (n + 1, 0, n, n + 1)
    top = order.where(f"position >= {n - 1}").orderBy("position").select("value", "n", "label_mean").collect()
    assert [tuple(r) for r in top][1] == ("hot", n, 5000.0) and top[0]["label_mean"] == 999.0
    low = order.where("position < 1000").agg(F.max("label_mean")).first()[0]
    assert low == 0.0
    ready = C.encoded(df.withColumn("other", F.lit("x")), order, ["value"])
    assert ready.columns == ["value", "label", "other"] and ready.count() == 3 * n
    assert ready.agg(F.max("value"), F.count("value")).first()[:] == (float(n), 3 * n)


def test_encoding_of_null_and_unseen_values(spark):
    train = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2), ("c", 0), (None, 9)], "k string, y int")
    order = C.category_order(train, ["k"], "y")
    assert sorted((r["value"], r["position"]) for r in order.collect()) == [("a", 1), ("b", 2), ("c", 0)]
    test = spark.createDataFrame([("c",), ("zz",), (None,)], "k string")
    assert [r[0] for r in C.encoded(test, order, ["k"]).collect()] == [0.0, None, None]
    index = {r["value"]: r["index"] for r in C.category_encoding(train, ["k"]).collect()}
    assert index == {"a": 0, "b": 1, "c": 2}


def test_equal_rows_are_one_with_their_number(spark):
    rng = np.random.default_rng(5)
    rows = [(float(k % 3), None if k % 4 == 0 else float(k % 4), float(k % 2)) for k in rng.permutation(240).tolist()]
    batches = spark.createDataFrame(rows, "y double, a double, b double").toArrow().to_batches(max_chunksize=50)
    packed = list(T._packed([[1.0, 2.0, 3.0], [0.0, 1.0]], 0.5, "<i2", 7)(batches))
    assert len({b.column(4)[0].as_py() for b in packed}) > 1  # the same rows of other tasks go to the same parts
    found = {}
    for b in [x.select([0, 1, 2, 3]) for x in packed * 2]:
        y, n, x = (np.frombuffer(b.column(c)[0].as_py(), t) for c, t in ((0, "f8"), (2, "i8"), (3, "<i2")))
        for key, m in zip(zip(y.tolist(), *x.reshape(2, -1).tolist()), n.tolist()):
            found.setdefault(key, []).append(m)
    want = {}
    for y, a, b in rows:
        key = (y, -1 if a is None else int(a) - 1, int(b))
        want[key] = want.get(key, 0) + 1
    assert found == {k: [m, m] for k, m in want.items()}
    import pyarrow as pa
    merged = T._merged(2, 0.5, "<i2")(pa.Table.from_batches([b for b in packed * 2]))
    assert sum(len(v.as_py()) // 8 for v in merged.column("_n")) == len(want)
    assert sum(np.frombuffer(v.as_py(), "i8").sum() for v in merged.column("_n")) == 2 * len(rows)


def test_predictions_in_batches_are_those_of_the_columns(spark):
    x, y, df = _data(spark, 4, 300)
    model = T.fit(df, ["a", "b", "c"], "y", rounds=6, depth=3)
    assert len(model.trees) == 6
    odd = df.union(spark.createDataFrame([(-1, float("nan"), None, 1e9, 0.0), (-2, None, None, None, None)], df.schema))
    both = model.predict(odd).select("id", F.col("prediction").alias("p")).join(model.predict_batches(odd), "id")
    assert both.columns == ["id", "p", "a", "b", "c", "y", "prediction"]
    assert both.where("p <=> prediction").count() == 302
