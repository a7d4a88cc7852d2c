"""Line dedup: lines on many distinct sites are boilerplate.

Built-in functions only. Each non-blank line (spaces around it cut off) is known by two
64-bit hashes. A HyperLogLog sketch of the sites of each line is built per task and merged
by the aggregation, so a hot line sends one small sketch per task. Where the estimate is
within ``BAND`` standard errors (and one site) of the threshold, the distinct sites are
counted exactly. Of a boilerplate line the first occurrence (smallest doc_id, then
place) stays, so that no content is lost; every other occurrence is cut out.

Cases: a null text stays null; a null site counts as one site of its own; blank lines stay
where they are and are never boilerplate; a document of which only blank lines are left is
``emptied``; rows with the same doc_id and text are one document (both keep what it keeps); a
null doc_id sorts first; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.llm.shared import columns, fresh, table, written

MIN_SITES = 8
LG_K = 12
#: Standard error of a sketch, and the width of the band that is counted exactly.
ERROR = 1.04 / (1 << LG_K) ** 0.5
BAND = 5


def _key(docs: DataFrame, doc_id: str, text: str) -> list[Column]:
    return [F.col(doc_id).alias("id"), F.xxhash64(text).alias("version")]


def lines(docs: DataFrame, doc_id: str, text: str, site: str) -> DataFrame:
    """The hashes of all non-blank lines: id, version, site, pos, h1, h2."""
    each = docs.select(*_key(docs, doc_id, text), F.coalesce(site, F.lit("")).alias("site"),
                       F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    line = F.trim("line")
    return each.where(line != "").select(
        "id", "version", "site", "pos", F.xxhash64(line).alias("h1"),
        F.xxhash64(F.lit(1), line).alias("h2"))  # the first argument seeds the second


def boilerplate(found: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Lines on min_sites sites or more, with their first occurrence: h1, h2, first."""
    spread = (found.groupBy("h1", "h2")
              .agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min(F.struct("id", "version", "pos")).alias("first"))
              .select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("sites")))
    margin = BAND * ERROR * min_sites + 1
    wide = written(spread.where(F.col("sites") >= min_sites - margin))
    sure = wide.where(F.col("sites") > min_sites + margin).select("h1", "h2", "first")
    near = wide.where(F.col("sites") <= min_sites + margin).select("h1", "h2", "first")
    exact = (found.select("h1", "h2", "site").join(near.select("h1", "h2"), ["h1", "h2"], "left_semi")
             .groupBy("h1", "h2", "site").agg(F.count("*").alias("n"))
             .groupBy("h1", "h2").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites))
    return sure.unionByName(near.join(exact.select("h1", "h2"), ["h1", "h2"], "left_semi"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source",
          min_sites: int = MIN_SITES) -> DataFrame:
    """The documents with boilerplate lines cut out of the text, and three more columns:
    n_lines, n_removed and emptied."""
    found = written(lines(docs, doc_id, text, site))
    drop = (found.join(boilerplate(found, min_sites), ["h1", "h2"])
            .where(~F.struct("id", "version", "pos").eqNullSafe(F.col("first")))
            .groupBy("id", "version").agg(F.collect_set("pos").alias("cut")))
    i, v, c, n_lines, n_removed, emptied = fresh(docs, "key_id", "key_version", "cut", "n_lines", "n_removed", "emptied")
    drop = drop.select(F.col("id").alias(i), F.col("version").alias(v), F.col("cut").alias(c))
    joined = docs.join(drop, docs[doc_id].eqNullSafe(drop[i]) & (F.xxhash64(docs[text]) == drop[v]), "left")
    split = F.split(text, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), c)
    cleaned = F.when(F.col(c).isNull(), F.col(text)).otherwise(
        F.array_join(F.transform(stay, lambda k: F.get(split, k)), "\n"))
    removed = F.coalesce(F.size(c), F.lit(0))
    return joined.withColumns({
        n_lines: F.when(F.col(text).isNull(), 0).otherwise(F.size(split)).cast("long"),
        n_removed: F.when(F.col(c).isNull(), 0).otherwise(removed).cast("long"),
        text: cleaned,
    }).withColumn(emptied, (F.col(n_removed) > 0) & (F.trim(F.translate(text, "\n", " ")) == "")).select(
        *columns(docs), n_lines, n_removed, emptied)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return dedup(docs).select("doc_id", "n_lines", "n_removed", "emptied", F.md5("text").alias("text_md5"))


OP8_SQL = f"""
WITH split AS (
  SELECT doc_id, coalesce(source, '') AS site, string_split(text, chr(10)) AS l FROM documents),
line AS (
  SELECT doc_id, site, unnest(range(len(l))) AS pos, unnest(l) AS raw FROM split),
spread AS (
  SELECT trim(raw) AS t, count(DISTINCT site) AS sites,
         min(struct_pack(d := doc_id, p := pos)) AS first
  FROM line WHERE trim(raw) <> '' GROUP BY 1),
marked AS (
  SELECT doc_id, pos, raw,
         coalesce(sites >= {MIN_SITES} AND struct_pack(d := doc_id, p := pos) <> first, false) AS cut
  FROM line LEFT JOIN spread ON trim(raw) = t AND trim(raw) <> ''),
rebuilt AS (
  SELECT doc_id, count(*) AS n_lines, sum(cut::BIGINT) AS n_removed,
         coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT cut), '') AS text
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(r.n_lines, 0) AS n_lines, coalesce(CAST(r.n_removed AS BIGINT), 0) AS n_removed,
       coalesce(r.n_removed > 0 AND trim(translate(r.text, chr(10), ' ')) = '', false) AS emptied,
       CASE WHEN d.text IS NOT NULL THEN md5(r.text) END AS text_md5
FROM documents d LEFT JOIN rebuilt r USING (doc_id)
"""
