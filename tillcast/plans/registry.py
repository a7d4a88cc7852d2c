"""Named queries: a Spark job and, where SQL can state it, the oracle SQL.

Each query reads the supplied tables of one scale factor directly (through the
fixture views), so its work grows with them. Float columns whose last bits
depend on summation order are rounded on both sides (``fuzz``): money sums to
their decimal grid (whole cents), other values to 6 decimals.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from tillcast.functions import round_half_even

Build = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    build: Build
    sql: str | None
    fuzz: tuple = ()          # float columns rounded on both sides: "col" (6 places) or (col, places)
    ops: tuple = ()           # SURVEY ids the query exercises
    doc: str = ""
    tags: tuple = field(default_factory=tuple)

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(spark, sf_dir)
        for c, places in self.fuzz_places():
            df = df.withColumn(c, round_half_even(c, places))
        return df

    def fuzz_places(self):
        return [(f, 6) if isinstance(f, str) else tuple(f) for f in self.fuzz]

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        if not self.fuzz:
            return self.sql
        from tillcast.plans.oracle import rn
        rep = ", ".join(f"{rn(c, n)} AS {c}" for c, n in self.fuzz_places())
        return f"SELECT * REPLACE ({rep}) FROM (\n{self.sql}\n) q"


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None, fuzz=(), ops=(), doc: str = ""):
    def deco(fn: Build) -> Build:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, tuple(fuzz), tuple(ops), doc or (fn.__doc__ or ""))
        return fn
    return deco


def load_all() -> dict[str, Query]:
    """Import the query modules (they register on import) and return the registry."""
    from tillcast.plans import queries  # noqa: F401
    return REGISTRY
