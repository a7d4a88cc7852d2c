"""Shared folder, fresh column names and session figures for the operators here."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this subpackage's Python files to the executors (``--py-files`` from within),
    so that its Python functions run there without an installation."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tillcast-py-"), "tillcast_llm.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("tillcast/__init__.py", "")
        for name in sorted(os.listdir(here)):
            if name.endswith(".py"):
                z.write(os.path.join(here, name), f"tillcast/llm/{name}")
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share. Where that is unset, a
    session of a single process (``local[n]``, as in tests) has a temporary folder; any other has an error."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
        if sc.applicationId not in _local:
            _local[sc.applicationId] = tempfile.mkdtemp(prefix="tillcast-llm-")
        root = _local[sc.applicationId]
    return f"{root.rstrip('/')}/tillcast-llm-{uuid.uuid4().hex}"


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """The rows written as a table in the shared folder and read back: cuts the lineage and
    survives lost executors."""
    path = shared_folder(df.sparkSession)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns(df: DataFrame, *without: str) -> list[Column]:
    """The columns of df, whatever characters their names have, but for some."""
    gone = {name.lower() for name in without}
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c.lower() not in gone]
