"""Connected components of a table of links by alternating large-star and small-star steps.

Every step is a minimum per node (partial aggregation, so a hot node sends one row per
task) joined back to the links, which adaptive execution splits where a node is hot. No
neighbourhood is gathered in one place and nothing but counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.llm.shared import written


def _star(links: DataFrame) -> DataFrame:
    """links (a, b) with a > b -> every larger neighbour of a node tied to the least of its
    neighbours and itself (large star), then every smaller one likewise (small star)."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
    low = large.groupBy("a").agg(F.min("b").alias("low"))
    small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
    return small.union(low.select("a", F.col("low").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b), both long; root is the least node of its
    component, and has no row of its own."""
    links = written(links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == state:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state, links = now, written(_star(links))
