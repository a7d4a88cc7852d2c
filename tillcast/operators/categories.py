"""Category values as ordered numbers (M1), for columns of any width.

No list of values reaches the driver: values are counted with a partial aggregate, numbered
in order by ranges, and joined back with :func:`~tillcast.operators.prepare.spread_join`, as one value may
hold a third of all rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.functions import exact_sum
from tillcast.operators.prepare import spread_join
from tillcast.session import written

#: Values of a category column that are broadcast.
SMALL = 100_000


def numbered(df: DataFrame, order: list[Column], group: str) -> DataFrame:
    """0-based ``index`` of every row within its ``group`` (of which there are few), in the given order, which
    must tell rows apart.

    The rows are dealt to ranges of (group, order) and written with the number of their range, so that it
    doesn't change if a task runs again; a range is numbered by itself, and the counts of the
    ranges give each its start.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(parts, F.col(group), *order).withColumn("_range", F.spark_partition_id()))
    here = Window.partitionBy(group, "_range")
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(group, "_range").agg(F.count("*").alias("_n")).select(
        group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # groups x ranges rows
    return (dealt.withColumn("_at", F.row_number().over(here.orderBy(*order)))
            .join(F.broadcast(starts), [group, "_range"])
            .withColumn("index", F.col("_start") + F.col("_at") - 1).drop("_range", "_at", "_start"))


def category_values(df: DataFrame, cols, label: str | None = None) -> DataFrame:
    """(column, value, n) of every value that occurs, with its ``label_mean`` if a label is given."""
    more = [F.col(label).cast("double").alias("_y")] if label else []
    cells = reduce(DataFrame.unionByName, [
        df.where(F.col(c).isNotNull()).select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), *more) for c in cols])
    mean = [(exact_sum("_y") / F.count("_y")).alias("label_mean")] if label else []
    return cells.groupBy("column", "value").agg(F.count("*").alias("n"), *mean)


def category_encoding(df: DataFrame, cols) -> DataFrame:
    """(column, value, index): the most frequent value of a column is 0, ties alphabetical."""
    return numbered(category_values(df, cols), [F.desc("n"), F.asc("value")], "column").select(
        "column", "value", F.col("index").cast("int").alias("index"))


def category_order(df: DataFrame, cols, label: str) -> DataFrame:
    """(column, value, n, label_mean, position): values by the mean of the label, ties alphabetical. For squared
    error the best split of a category's values in two is a cut in this order."""
    ordered = numbered(category_values(df, cols, label), [F.asc("label_mean"), F.asc("value")], "column")
    return ordered.select("column", "value", "n", "label_mean", F.col("index").alias("position"))


def encoded(df: DataFrame, order: DataFrame, cols) -> DataFrame:
    """df with every category column as the position of its value (double); NULL for NULL and for values
    that ``order`` (a written table) doesn't have. Up to ``SMALL`` values of a column are broadcast; more are
    joined by a spread join."""
    width = {r["column"]: r["n"] for r in order.groupBy("column").agg(F.count("*").alias("n")).collect()}
    for c in cols:
        facts = order.where(F.col("column") == c).select(
            F.col("value").alias("_value"), F.col("position").cast("double").alias("_position"))
        keyed = df.withColumn("_value", F.col(c).cast("string"))
        if width.get(c, 0) <= SMALL:
            out = keyed.join(F.broadcast(facts), "_value", "left")
        else:
            out = spread_join(keyed, facts, ["_value"], hint="merge")
        df = out.withColumn(c, F.col("_position")).select(*df.columns)
    return df
