"""Tree models for daily units and their scores (M1-M11), on Spark ML.

Spark ML trees train distributed (per-partition histograms merged per level),
so the fit scales with the feature table. Differences to the reference's
libraries: boosting is plain gradient boosting (no second-order
regularisation), and missing values are not native, so NULL features become 0
with a 0/1 indicator column. :mod:`tillcast.operators.boosting` has second-order boosting
that takes missing values as they are.

Categories are positions in the order of their mean label (:mod:`tillcast.operators.categories`), plain
numbers to the trees, so neither the driver nor ``maxBins`` sees how wide a category is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.operators.categories import category_order, encoded
from tillcast.schemas import CATEGORICAL_FEATURES, MODEL_FEATURES, TARGET
from tillcast.session import checkpoint_dir, written

# Fixed values of the reference models.
GBT_PARAMS = dict(maxDepth=5, stepSize=0.1, maxIter=50, seed=42)
RF_PARAMS = dict(maxDepth=5, numTrees=100, featureSubsetStrategy="all", seed=42)
NULLABLE = ("medianDiscPerc", "rolling_qty_sold_std")
#: Bins of a feature, however many values it has.
MAX_BINS = 64


def prepare_features(df: DataFrame, nullable=NULLABLE, target: str = TARGET) -> DataFrame:
    """NULL -> 0 plus ``<col>_missing`` indicators; categoricals as strings;
    ``label`` = ``target`` as double."""
    out = df
    for c in nullable:
        if c in df.columns:
            out = (out.withColumn(f"{c}_missing", F.col(c).isNull().cast("double"))
                   .withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(0.0))))
    for c in CATEGORICAL_FEATURES:
        out = out.withColumn(c, F.col(c).cast("string"))
    return out.withColumn("label", F.col(target).cast("double"))


@dataclass
class TreeModel:
    """Fitted trees with the order of category values they were fitted on."""

    trees: Model
    order: DataFrame
    columns: list[str]

    def features(self, df: DataFrame) -> DataFrame:
        """M2: one vector of all features; NULL and unseen categories are -1."""
        ready = encoded(df, self.order, CATEGORICAL_FEATURES).fillna(-1.0, CATEGORICAL_FEATURES)
        return VectorAssembler(inputCols=self.columns, outputCol="features", handleInvalid="keep").transform(ready)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.trees.transform(self.features(df))


def fit_trees(train: DataFrame, trees, features=MODEL_FEATURES, nullable=NULLABLE) -> TreeModel:
    """M1 + M2 + fit of a Spark ML tree estimator on ``label``.

    The shared checkpoint folder is registered first, so boosting is checkpointed every
    ``checkpointInterval`` (10) rounds and a lost executor doesn't replay the whole chain of rounds.
    """
    checkpoint_dir(train.sparkSession)
    order = written(category_order(train, CATEGORICAL_FEATURES, "label"))
    model = TreeModel(None, order, [*features, *(f"{c}_missing" for c in nullable if c in train.columns)])
    model.trees = trees.fit(model.features(train))
    return model


def fit_gbt(train: DataFrame, features=MODEL_FEATURES, nullable=NULLABLE, **over) -> TreeModel:
    """M3: gradient-boosted trees, squared error, depth 5, rate 0.1, 50 rounds, seed 42."""
    return fit_trees(train, GBTRegressor(featuresCol="features", labelCol="label", maxBins=MAX_BINS,
                                         **{**GBT_PARAMS, **over}), features, nullable)


def fit_forest(train: DataFrame, **over) -> TreeModel:
    """M8: random forest, depth 5, 100 trees, all features per split, seed 42."""
    return fit_trees(train, RandomForestRegressor(featuresCol="features", labelCol="label", maxBins=MAX_BINS,
                                                  **{**RF_PARAMS, **over}))


def predict(model: TreeModel, df: DataFrame, rounded: bool = True) -> DataFrame:
    """M4: predictions, rounded to the nearest integer (half even) if ``rounded``."""
    p = model.transform(df)
    pred = F.rint("prediction") if rounded else F.col("prediction")
    return p.withColumn("pred", pred)


def scores(pred: DataFrame, col: str = "pred", keys=()) -> DataFrame:
    """M5 + M6: exact-match accuracy and R2 of ``col`` against ``label``."""
    y, p = F.col("label"), F.col(col)
    agg = pred.groupBy(*keys).agg(
        F.avg((p == y).cast("double")).alias("accuracy"),
        F.sum((y - p) * (y - p)).alias("_sse"),
        F.avg(y).alias("_mean"), F.count("*").alias("n"),
        F.sum(y * y).alias("_syy"))
    sst = F.col("_syy") - F.col("n") * F.col("_mean") * F.col("_mean")
    # R2 is NULL for a constant label (zero variance) instead of an ANSI error
    return agg.select(*keys, "n", "accuracy",
                      (F.lit(1.0) - F.try_divide(F.col("_sse"), sst)).alias("r2"))


def feature_importance(model: TreeModel, spark) -> DataFrame:
    """M7: importance per feature name, ranked (1 = most important)."""
    imp = model.trees.featureImportances.toArray().tolist()
    rows = sorted(zip(model.columns, imp), key=lambda t: (-t[1], t[0]))
    return spark.createDataFrame([(c, float(v), i + 1) for i, (c, v) in enumerate(rows)],
                                 "feature string, importance double, rank int")


def above_noise(importance: DataFrame) -> DataFrame:
    """M9: features ranked above both noise columns."""
    noise = importance.where(F.col("feature").isin("random_noise1", "random_noise2"))
    best_noise = noise.select(F.min("rank")).scalar()
    return importance.where(F.col("rank") < best_noise)


def ensemble(preds: list[DataFrame], keys=("itemID", "date")) -> DataFrame:
    """Mean of several models' predictions per row key."""
    out = None
    for i, p in enumerate(preds):
        q = p.select(*keys, F.col("prediction").alias(f"_p{i}"))
        out = q if out is None else out.join(q, list(keys))
    mean = sum(F.col(f"_p{i}") for i in range(len(preds))) / len(preds)
    return out.select(*keys, mean.alias("prediction"))


def item_forecast(pred: DataFrame, col: str = "prediction") -> DataFrame:
    """Per item, the sum of daily predictions as a non-negative integer."""
    return pred.groupBy("itemID").agg(
        F.greatest(F.lit(0), F.rint(F.sum(col))).cast("long").alias("demandPrediction"))


def direct_forecast(features: DataFrame, grid: DataFrame, origin: str, horizon: int = 14,
                    **gbt_over) -> DataFrame:
    """M11, direct form: boosted trees on the units of the next ``horizon`` days
    (T6 label), fitted on the train days whose horizon lies inside train and
    applied at the forecast origin (the last train day, ``origin``). Returns one
    non-negative integer ``demandPrediction`` per item.
    """
    from tillcast.operators.series import demand_label
    label = f"demand_next_{horizon}"
    train_grid = grid.where(F.col("split") == "train")
    lab = demand_label(train_grid, horizon).select("split", "itemID", "date", label)
    ft = features.where(F.col("split") == "train").join(lab, ["split", "itemID", "date"])
    fit_rows = prepare_features(ft.where(F.col(label).isNotNull()), target=label)
    at_origin = prepare_features(ft.where(F.col("date") == F.lit(origin).cast("date")),
                                 target=label)
    model = fit_gbt(fit_rows, **gbt_over)
    return predict(model, at_origin, rounded=False).select(
        "itemID", F.greatest(F.lit(0), F.rint("prediction")).cast("long")
        .alias("demandPrediction"))
