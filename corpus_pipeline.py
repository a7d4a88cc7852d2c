"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as
Parquet in the shared folder and read again as the next stage's documents. All stages but
the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.llm import line_dedup, packing, secret_scan, shingle_join, toxicity
from tillcast.llm.shared import columns, fresh, table, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the severity model, fitted on the labels table, doesn't reject."""
    (t,) = fresh(docs, "toxicity")
    return toxicity.score(docs, table(spark, sf_dir, "labels"), t).where(~F.col(t)["toxic"]).drop(t)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines of many sites; those of which nothing is left go."""
    found = line_dedup.dedup(docs)
    return found.where(~F.col(found.columns[-1])).select(*columns(docs))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones; documents without words all stay."""
    return shingle_join.one_of_each(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets replaced by a mark."""
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of every document and their places in training sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", without_toxic), ("line dedup", without_boilerplate),
          ("n-gram Jaccard join", without_near_copies), ("secret scans", without_secrets), ("packing", packed)]

#: SQL cannot state a trained model, entropy windows or token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
