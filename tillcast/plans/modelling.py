"""Models on the feature table, their scores and a 14-day forecast."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.functions import promotion_dates
from tillcast.operators import features as X
from tillcast.operators import model as M
from tillcast.plans import features as E1
from tillcast.schemas import CATEGORICAL_FEATURES, MODEL_FEATURES
from tillcast.sources.fixtures import Calendar


def model_report(features: DataFrame, grid: DataFrame | None = None,
                 origin: str | None = None) -> dict[str, DataFrame]:
    """Fit boosted trees and a random forest on the train split, score them on
    test, rank feature importance, and sum the ensemble's test predictions per
    item into an integer forecast. With the dense ``grid`` and the forecast
    ``origin`` (last train day), also the direct 14-day forecast (M11).
    ``features`` should be a written (or checkpointed) table: the fits read it
    several times."""
    ft = M.prepare_features(features)
    train, test = ft.where(F.col("split") == "train"), ft.where(F.col("split") == "test")
    gbt, rf = M.fit_gbt(train), M.fit_forest(train)
    pg = M.predict(gbt, test, rounded=True)
    pr = M.predict(rf, test, rounded=False)
    imp = M.feature_importance(gbt, features.sparkSession)
    out = {
        "gbt_scores": M.scores(pg),
        "rf_scores": M.scores(pr),
        "importance": imp,
        "above_noise": M.above_noise(imp),
        "forecast": M.item_forecast(M.ensemble([pg, pr])),
    }
    if grid is not None and origin is not None:
        out["direct_forecast"] = M.direct_forecast(features, grid, origin)
    return out


# --- M11: the forecast of the brief ---------------------------------------------------

HORIZON_FEATURES = [*MODEL_FEATURES, "promo_days"]


def horizon_table(orders: DataFrame, items: DataFrame, infos: DataFrame, cal: Calendar) -> DataFrame:
    """Features of every (item, day) up to the day before ``cal.forecast_start``, with the
    units of the next ``cal.horizon`` days (``demand``) and the promotion days among them
    (``promo_days``).

    The whole history is one series per item. On its last day, the origin, ``demand`` is
    unknown (NULL), ``promo_days`` come from the promotion dates in infos, and every item
    of ``items`` has a row: those never sold have 0 in all series columns and their
    simulation price as price.
    """
    one = replace(cal, split_date=cal.test_end)
    ft = E1.feature_table(orders, items, one, drop_incomplete=False).drop("split")
    ahead = Window.partitionBy("itemID").orderBy("date").rowsBetween(1, cal.horizon)
    whole = F.count("*").over(ahead) == cal.horizon
    ft = ft.withColumns({"demand": F.when(whole, F.sum("qty_sold").over(ahead)),
                         "promo_days": F.when(whole, F.sum("promotion").over(ahead))})
    history = ft.where("demand is not null")

    origin = F.lit(cal.test_end).cast("date")
    last = ft.where(F.col("date") == origin).drop("promo_days", "demand", "date", *[
        c for c in items.columns if c != "itemID"])
    inside = F.filter(promotion_dates("promotion"), lambda d: d.between(
        F.lit(cal.forecast_start).cast("date"), F.lit(cal.forecast_end).cast("date")))
    plan = infos.select("itemID", "simulationPrice", F.coalesce(F.size(inside), F.lit(0)).cast("long").alias("promo_days"))
    now = (items.join(last, "itemID", "left").join(plan, "itemID", "left")
           .withColumn("date", origin).withColumn("demand", F.lit(None).cast("long"))
           .withColumns({c: F.coalesce(c, "simulationPrice") for c in ("maxItemPrice", "minItemPrice", "Price", "PriceToday")})
           .withColumns({"promo_days": F.when(F.col("promo_days") > 0, F.col("promo_days")).otherwise(0)})
           .drop("weekDay", "day", "weekOfMonth").select("*", *X.date_field_columns()))
    columns = ["itemID", "date", "demand", "promo_days", *[c for c in MODEL_FEATURES if c != "itemID"]]
    return history.select(*columns).unionByName(now.select(*columns))


def forecast_all_items(table: DataFrame, cal: Calendar, **gbt_over) -> DataFrame:
    """One non-negative integer ``demandPrediction`` per item for the ``cal.horizon`` days
    from ``cal.forecast_start``, by boosted trees fitted on the known horizons of
    :func:`horizon_table`, which should be a written table."""
    numeric = [c for c in HORIZON_FEATURES if c not in CATEGORICAL_FEATURES]
    ready = table.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numeric if c != "itemID"})
    ready = ready.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in CATEGORICAL_FEATURES})
    ready = ready.withColumn("label", F.col("demand").cast("double"))
    train = ready.where("label is not null")
    now = ready.where((F.col("date") == F.lit(cal.test_end).cast("date")) & F.col("label").isNull())
    if train.isEmpty():
        return now.select("itemID", F.lit(0).cast("long").alias("demandPrediction"))
    model = M.fit_gbt(train, HORIZON_FEATURES, nullable=(), **gbt_over)
    return M.predict(model, now, rounded=False).select(
        "itemID", F.greatest(F.lit(0), F.rint("prediction")).cast("long").alias("demandPrediction"))


def horizon_schema(items: DataFrame) -> T.StructType:
    """Types of :func:`horizon_table`, to read it back without inference."""
    from tillcast.sources.files import feature_schema

    of = {f.name: f.dataType for f in feature_schema(items.schema)}
    return T.StructType([T.StructField("itemID", T.LongType()), T.StructField("date", T.DateType()),
                         T.StructField("demand", T.LongType()), T.StructField("promo_days", T.LongType()),
                         *[T.StructField(c, of[c]) for c in MODEL_FEATURES if c != "itemID"]])
