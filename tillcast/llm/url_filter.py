"""URL filters: host and path rules first, gradient-boosted trees for the rest.

Host and path are cut out of a url; a rule (host/path) fits its host and all its subdomains if the
path starts with the rule's; the longest fitting rule decides. Urls that a rule decides are the
labelled urls. On a bounded sample of them (``SAMPLE_ROWS``, chosen by a hash of the url) Spark ML's
gradient-boosted trees learn lexical features: lengths, depth, digit ratio, character entropy, parameter
counts, and statistics of suffixes (the last label of the host; the last two; the last two with the first
path segment): the share of all urls that have them, the blocked share of the labelled ones, and how much
evidence that is, ``n / (n + SHRINK)``. A suffix's blocked share is shrunk towards its parent suffix's with the weight of
``SHRINK`` urls, the last label's towards that of all labelled urls, so a suffix without labels has its parent's.
These statistics cover all urls. A labelled url's own fifth of the urls is left out of its shares, so
that its label doesn't reach its features.

The labels restate their rules' suffixes, so trees that always see these learn nothing else. Therefore
each sampled url is learned from once per number of hidden suffixes: with all seen, without the
section, without the site too, and without any. There the lexical features have to do. Both labels weigh the
same, so a url that nothing speaks for or against has a probability near 1/2, and
is blocked from ``BLOCK_FROM`` on only.

Cases: a null url, or one without ``://``, has an empty host and path and fits no rule; its features
are zeros. Repeated urls are judged alike. If the rules don't give both labels, the method allows
everything. An empty table gives no rows. Hot suffixes are counted by partial sums; the counts are written,
so adaptive execution broadcasts them if they are small and splits a hot suffix's urls if not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.llm.shared import ship, table, written
from tillcast.llm.textbuf import Chunk, chunks

#: (action, host, path prefix), a policy in the reading order of its author.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))

SAMPLE_ROWS = 20_000
TREES = 10
DEPTH = 4
LEAST_ROWS = 20   # of a leaf
FOLDS = 5
SHRINK = 8.0
BLOCK_FROM = 0.75

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LEXICAL = ["length", "host_length", "labels", "depth", "digit_ratio", "entropy", "parameters", "hyphens", "has_fragment"]
LEVELS = ("top", "site", "section")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def by_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as a string, and its action; null if none fits."""
    rule = action = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, action = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(action)
    return rule, action


def lexical(chunk: Chunk) -> np.ndarray:
    """The LEXICAL features of the urls of a chunk."""
    data, bounds = chunk.data, chunk.bounds
    n = np.diff(bounds)
    count = lambda chars: chunk.per_text(np.isin(data, list(chars)))
    doc = np.repeat(np.arange(chunk.n), n)
    pair, c = np.unique(doc * 256 + data, return_counts=True)
    share = c / np.maximum(n, 1)[pair // 256]
    entropy = np.bincount(pair // 256, -share * np.log2(share), minlength=chunk.n)
    host = np.zeros(chunk.n)
    labels = np.zeros(chunk.n)
    for i in range(chunk.n):
        rest = chunk.text(i).partition(b"://")[2]
        name = rest.replace(b"?", b"/").replace(b"#", b"/").partition(b"/")[0]
        host[i], labels[i] = len(name), name.count(b".") + bool(name)
    depth = np.maximum(count(b"/") - 2, 0)
    return np.column_stack([n, host, labels, depth, count(b"0123456789") / np.maximum(n, 1), entropy,
                            count(b"="), count(b"-"), count(b"#") > 0]).astype(np.float64)


def lexical_column(url: pa.Array) -> pa.Array:
    parts = [lexical(c) for c in chunks(url)]
    values = np.concatenate(parts) if parts else np.zeros((0, len(LEXICAL)))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * len(LEXICAL), pa.int32()),
                                    pa.array(values.reshape(-1)))


def suffixes(host: Column, path: Column) -> dict[str, Column]:
    site = F.substring_index(host, ".", -2)
    return {"top": F.substring_index(host, ".", -1), "site": site,
            "section": F.concat_ws("/", site, F.get(F.split(path, "/"), 1))}


def with_counts(urls: DataFrame) -> DataFrame:
    """Adds to urls (with label, fold and the LEVELS columns) of each suffix the urls that have it, and
    the labelled and blocked ones outside a labelled url's own fold: ``<level>_urls``, ``_n`` and ``_b``. All
    levels are counted in one pass."""
    each = urls.select("fold", "label", F.explode(F.array(*[
        F.struct(F.lit(level).alias("level"), F.col(level).alias("suffix")) for level in LEVELS])).alias("s"))
    counts = written(each.groupBy("s.level", "s.suffix").agg(F.count("*").alias("urls"), *[
        F.sum(F.when((F.col("fold") == f) & (F.col("label") >= y), 1).otherwise(0)).alias(f"s{y}{f}") for y in (0, 1) for f in range(FOLDS)]))
    for level in LEVELS:
        stats = counts.where(F.col("level") == level).drop("level").withColumnRenamed("suffix", level)

        def total(y: int) -> Column:
            own = F.element_at(F.array(*(F.col(f"s{y}{f}") for f in range(FOLDS))), F.col("fold") + 1)
            return sum((F.col(f"s{y}{f}") for f in range(FOLDS)), F.lit(0)) - F.when(
                F.col("label").isNotNull(), own).otherwise(0)

        urls = (urls.join(stats, level).withColumns({f"{level}_n": total(0), f"{level}_b": total(1)})
                .withColumnRenamed("urls", f"{level}_urls").drop(*(f"s{y}{f}" for y in (0, 1) for f in range(FOLDS))))
    return urls


def features(all_urls: int, prior: float, hidden: Column) -> Column:
    """The trees' features; the last ``hidden`` LEVELS are not seen. A suffix without labels is as if not
    seen: how many urls have it would only tell the trees which suffix it is."""
    share, out = F.lit(prior), []
    for k, level in enumerate(LEVELS):
        seen = hidden < len(LEVELS) - k
        n, b = (F.when(seen, F.col(f"{level}_{c}")).otherwise(0) for c in ("n", "b"))
        share = (b + SHRINK * share) / (n + SHRINK)
        out += [F.when(n > 0, F.col(f"{level}_urls") / float(max(all_urls, 1))).otherwise(0.0), n / (n + SHRINK), share]
    return F.concat("lexical", F.array(*out))


FEATURES = [*LEXICAL, *(f"{level}_{what}" for level in LEVELS for what in ("share", "evidence", "blocked"))]


def fitted(counted: DataFrame, every: int, labelled: int, blocked: int, sample_rows: int = SAMPLE_ROWS) -> GBTClassificationModel:
    """The trees of a sample of the labelled urls, each with 0 to 3 hidden levels of labels."""
    slots = max(1, round(1_000_000 * min(1.0, sample_rows / labelled)))
    sample = (counted.where("label is not null")
              .where(F.pmod(F.xxhash64("url", "page_id"), F.lit(1_000_000)) < slots)
              .withColumn("hidden", F.explode(F.sequence(F.lit(0), F.lit(len(LEVELS)))))
              .select(F.col("label").cast("double").alias("label"),
                      F.when(F.col("label") == 1, labelled / (2.0 * blocked)).otherwise(labelled / (2.0 * (labelled - blocked))).alias("weight"),
                      array_to_vector(features(every, blocked / labelled, F.col("hidden"))).alias("features")))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, minInstancesPerNode=LEAST_ROWS, weightCol="weight", seed=7,
                          checkpointInterval=-1)
    return trees.fit(written_vectors(sample))


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES,
          sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block (the method's probability)."""
    ship(pages.sparkSession)
    raw = F.col("url")
    rule, action = by_rule(F.col("host"), F.col("path"), rules)
    urls = (pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
            .withColumns({"host": host_of(raw), "path": path_of(raw)})
            .withColumns({"rule": rule, "action": action}))
    urls = urls.withColumns({
        "label": F.when(F.col("action") == "block", 1).when(F.col("action") == "allow", 0),
        "fold": F.pmod(F.xxhash64(F.coalesce(raw, F.lit("")), F.lit(7)), F.lit(FOLDS)).cast("int"),
        "lexical": F.arrow_udf(lexical_column, "array<double>")(F.coalesce(raw, F.lit(""))),
        **suffixes(F.col("host"), F.col("path"))})
    table_ = written(with_counts(written(urls)).select(
        "page_id", "url", "host", "path", "rule", "action", "label", "lexical", *[f"{level}_{c}" for level in LEVELS for c in ("urls", "n", "b")]))
    every, labelled, blocked = table_.agg(F.count("*"), F.count("label"), F.sum("label")).first()
    if not blocked or blocked == labelled:
        judged = table_.withColumn("p_block", F.lit(0.0))
    else:
        model = fitted(table_, every, labelled, blocked, sample_rows)
        judged = (model.transform(table_.withColumn("features", array_to_vector(features(every, blocked / labelled, F.lit(0)))))
                  .withColumn("p_block", vector_to_array("probability")[1]))
    verdict = F.coalesce("action", F.when(F.col("p_block") >= BLOCK_FROM, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "p_block")


def written_vectors(sample: DataFrame) -> DataFrame:
    """The bounded sample in a few partitions of the shared folder, as the trees read it many times."""
    return written(sample.repartition(4))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
