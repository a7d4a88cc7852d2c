"""Ranked lexical search by dense blocked matrix products.

The items' terms are the compact vocabulary. One pass over the documents keeps, per tile of some hundred
documents, each document's length and its vocabulary terms with their counts; document counts of
terms are summed over these tiles. Then every tile is scored: vocabulary tiles of item weights
(items x terms) times document impacts (terms x documents) in float64. A tile of terms is cut
where an item's weights, times the largest impact, could reach 2**53, so every partial sum
is exact; partial sums are added as 64-bit integers. A term whose single weight is too large for that is
multiplied in integers. Of each tile the k best documents of an item are kept with all ties at the
k-th score until ids decide, and a task carries its k best from tile to tile.

Items come in groups of at most ``item_groups.GROUP_BYTES`` bytes, each a job with its own broadcast, so
what is broadcast doesn't grow with the tables. Terms are told apart by 64-bit hashes.

Cases: a null or empty text has no terms and is never found; texts are read whole; rows that repeat a
doc_id are documents of their own; a null doc_id comes last among equal scores and is returned as
null; items without terms, or of which no term occurs, give no rows; rows that repeat item_id and text are
one item, and different texts of one item_id are added up; a null item_id is an item; empty tables
give no rows. The largest impact of a term is below 1000000, so an item of up to some 300,000 words needs one
product; products stay in 64 bits as long as 75 * words of a document * documents does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillcast.llm.item_groups import groups, item_terms, number_of, terms
from tillcast.llm.shared import ship, table, written
from tillcast.llm.textbuf import chunks

K = 10
#: Documents, items and terms of a tile.
DOCS, ITEMS, TERMS = 1024, 256, 2048
#: Sums below this are exact in float64; no impact reaches MOST.
EXACT, MOST = 1 << 53, 1_000_000
#: Places that the best rows of an item come from before they meet.
SALT = 32

TILE = "n long, ids binary, known binary, size binary, at binary, term binary, tf binary"


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, size: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The impact of counts tf in documents of these sizes."""
    m = 100 - 75 + (75 * size * n_docs) // max(n_terms, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def to_tiles(vocabulary):
    """(doc_id, text) -> tiles of the vocabulary terms of some documents, a row each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            ids, valid = batch.column(0), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            for chunk in chunks(batch.column(1), rows=DOCS):
                found, doc = terms(chunk)
                size = np.bincount(doc, minlength=chunk.n).astype(np.int64)
                number = number_of(found, known)
                mine = number >= 0
                key, tf = np.unique(doc[mine] * len(known) + number[mine], return_counts=True)
                row, term = key // max(len(known), 1), key % max(len(known), 1)
                some = slice(chunk.first, chunk.first + chunk.n)
                yield pa.RecordBatch.from_arrays([pa.array([chunk.n], pa.int64())] + [pa.array([x.tobytes()], pa.binary()) for x in (
                    ids[some].astype(np.int64), valid[some], size, np.searchsorted(row, np.arange(chunk.n + 1)).astype(np.int64),
                    term.astype(np.uint32), tf.astype(np.uint32))], ["n", "ids", "known", "size", "at", "term", "tf"])
    return run


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles -> (term, n): documents with each term; at -1 documents with any, at -2 all terms."""
    for batch in batches:
        size = np.frombuffer(b"".join(batch.column("size").to_pylist()), np.int64)
        term = np.frombuffer(b"".join(batch.column("term").to_pylist()), np.uint32)
        at, n = np.unique(term, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((at.astype(np.int64), [-1, -2]))),
             pa.array(np.concatenate((n, [np.count_nonzero(size), size.sum()])).astype(np.int64))], ["term", "n"])


class Items:
    """The items of a group in tiles of ITEMS, each with the weights of its own vocabulary."""

    def __init__(self, item: np.ndarray, term: np.ndarray, n_items: int, vocabulary: int):
        key, self.count = np.unique(item * max(vocabulary, 1) + term, return_counts=True)
        self.item, self.term = key // max(vocabulary, 1), key % max(vocabulary, 1)
        self.n, self.vocabulary = n_items, vocabulary

    def tiles(self, w: np.ndarray):
        """Per tile: first item, number of items, its terms, and cuts of a matrix of weights by terms:
        (first term, last, exact in float64)."""
        total = self.count * w[self.term]
        for lo in range(0, self.n, ITEMS):
            a, b = np.searchsorted(self.item, (lo, lo + ITEMS))
            here = slice(a, b)
            here = np.arange(a, b)[total[here] > 0]
            own, column = np.unique(self.term[here], return_inverse=True)
            n = min(ITEMS, self.n - lo)
            yield lo, n, own, (self.item[here] - lo, column, total[here]), cuts(self.item[here] - lo, column, total[here], n, len(own))


def cuts(item: np.ndarray, column: np.ndarray, total: np.ndarray, n: int, width: int) -> list[tuple[int, int, bool]]:
    """Ranges of columns of at most TERMS, in which no item's sum of weights * MOST reaches EXACT; a
    column that does so alone is marked for integers."""
    order = np.argsort(column, kind="stable")
    item, total, at = item[order], total[order], np.searchsorted(column[order], np.arange(width + 1))
    out, lo, run = [], 0, np.zeros(n, np.int64)
    for c in range(width):
        these = slice(at[c], at[c + 1])
        if total[these].max(initial=0) >= EXACT // MOST:
            out += [(lo, c, True)] * (c > lo) + [(c, c + 1, False)]
            lo, run[:] = c + 1, 0
            continue
        after = run[item[these]] + total[these]
        if c - lo == TERMS or after.max(initial=0) >= EXACT // MOST:
            out.append((lo, c, True))
            lo, run[:] = c, 0
            after = total[these]
        run[item[these]] = after
    return out + [(lo, width, True)] * (width > lo)


def best(item, score, known, ids, k: int):
    """The k best rows of every item: highest score, then known ids, smallest first."""
    order = np.lexsort((ids, ~known, -score, item))
    item, score, known, ids = item[order], score[order], known[order], ids[order]
    place = np.arange(len(item)) - np.searchsorted(item, item)
    return tuple(x[place < k] for x in (item, score, known, ids))


def searcher(known, k: int):
    """Tiles -> (item, score, doc_id): at most k rows an item and task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, n_docs, n_terms, w = known.value
        tiles = list(items.tiles(w))
        top = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
        floor = np.ones(items.n, np.int64)  # a score that a document must reach
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda name, kind: np.frombuffer(batch.column(name)[r].as_buffer(), kind)
                size, ids, valid, term = get("size", np.int64), get("ids", np.int64), get("known", bool), get("term", np.uint32)
                doc = np.repeat(np.arange(len(size)), np.diff(get("at", np.int64)))
                value = impacts(get("tf", np.uint32).astype(np.int64), size[doc], n_docs, n_terms)
                for lo, n, own, (item, column, total), parts in tiles:
                    place = np.full(items.vocabulary, -1, np.int32)
                    place[own] = np.arange(len(own))
                    at = place[term]
                    score = np.zeros((n, len(size)), np.int64)
                    for c, d, exact in parts:
                        kind = np.float64 if exact else np.int64
                        weights, impact = np.zeros((n, d - c), kind), np.zeros((d - c, len(size)), kind)
                        mine = (column >= c) & (column < d)
                        weights[item[mine], column[mine] - c] = total[mine]
                        here = (at >= c) & (at < d)
                        impact[at[here] - c, doc[here]] = value[here]
                        score += (weights @ impact).astype(np.int64)
                    i, j = np.nonzero(score >= floor[lo:lo + n, None])
                    if not len(i):
                        continue
                    top = best(*(np.concatenate(x) for x in zip(top, (i + lo, score[i, j], valid[j], ids[j]))), k)
                    first = np.searchsorted(top[0], np.arange(items.n + 1))
                    full = np.flatnonzero(np.diff(first) == k)
                    floor[full] = top[1][first[full + 1] - 1]
        yield pa.RecordBatch.from_arrays([pa.array(top[0]), pa.array(top[1]), pa.array(top[3], mask=~top[2])],
                                         ["item", "score", "doc_id"])
    return run


def search(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text", group_bytes: int | None = None) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for group in groups(items, item_id, item_text, **({"limit": group_bytes} if group_bytes else {})):
        row_ids, row, hashes = item_terms(group)
        ids = row_ids.unique()
        of_row = row_ids.dictionary_encode("encode").indices.to_numpy()
        vocabulary, term = np.unique(hashes, return_inverse=True)
        tiles = written(rows.mapInArrow(to_tiles(spark.sparkContext.broadcast(vocabulary)), TILE))
        sums = tiles.select("size", "term").mapInArrow(counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        found = sums.toArrow()  # one row a term of the group
        key, n = found.column("term").to_numpy(), found.column("n").to_numpy()
        n_docs, n_terms = int(n[key == -1].sum()), int(n[key == -2].sum())
        w = np.zeros(len(vocabulary), np.int64)
        w[key[key >= 0]] = [weight(n_docs, df) for df in n[key >= 0].tolist()]
        known = spark.sparkContext.broadcast((Items(of_row[row].astype(np.int64), term, len(ids), len(vocabulary)), n_docs, n_terms, w))
        names = spark.createDataFrame(pa.table({"item": pa.array(np.arange(len(ids))), "item_id": ids}))
        scored = tiles.mapInArrow(searcher(known, k), "item long, score long, doc_id long")
        order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
        near = Window.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(SALT))).orderBy(*order)
        last = Window.partitionBy("item").orderBy(*order)
        ranked = (scored.withColumn("near", F.row_number().over(near)).where(F.col("near") <= k)
                  .withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k))
        part = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return items.select(F.col(item_id).alias("item_id"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"),
                            F.lit(0).cast("long").alias("score")).where(F.lit(False))
    return out


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = f"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents WHERE text IS NOT NULL),
item AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM benchmark WHERE text IS NOT NULL),
total AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM doc WHERE len(t) > 0),
q AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest(t) AS term FROM item) GROUP BY ALL),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM doc) GROUP BY ALL),
w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * max(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, total WHERE term IN (SELECT term FROM q) GROUP BY term),
scored AS (
  SELECT item_id, r, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(t) * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM tf JOIN w USING (term) JOIN q USING (term) JOIN doc USING (r), total GROUP BY ALL),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scored JOIN doc USING (r) WHERE score > 0)
SELECT * FROM ranked WHERE rank <= {K}
"""
