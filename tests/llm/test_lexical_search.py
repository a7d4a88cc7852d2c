import math
import re
from collections import Counter

import duckdb
import numpy as np

from tests.llm.tables import documents  # noqa: F401  a fixture
from tillcast.llm import lexical_search as ls

SMALL = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    bags = [(d, Counter(lowered(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    query = {}
    for i, t in dict.fromkeys(items):
        query.setdefault(i, Counter()).update(lowered(t))
    out = set()
    for i, q in query.items():
        scored = []
        for d, b in bags:
            m = 25 + 75 * sum(b.values()) * n_docs // max(n_terms, 1)
            s = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m))
                    for t, c in q.items() if b[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        for rank, (s, _, _, d) in enumerate(sorted(scored)[:k], 1):
            out.add((i, rank, d, -s))
    return out


def items_table(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def found(df):
    rows = [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


DOCS = [(7, "The cat, the CAT and the hat"), (3, "the cat the cat and the hat"), (1, "dog"), (2, None), (4, ""), (5, "dog"), (5, "dog"),
        (None, "dog"), (9, "é école É 123 cat_hat x\x00y"), (10, "?!"), (11, "hat " * 5000 + "rare"), (12, "dog cat")]
ITEMS = [(1, "cat hat cat"), (2, "DOG dog!"), (2, "DOG dog!"), (3, None), (4, "..."), (None, "rare x y"), (5, "école é 123"), (6, "missing"),
         (7, "dog"), (7, "cat")]


def test_scores_ranks_and_ties_against_brute_force(spark, documents):
    docs = documents(DOCS).selectExpr("*", "1 AS rank", "'x' AS item_id")
    items = items_table(spark, ITEMS)
    assert found(ls.search(docs, items)) == brute(DOCS, ITEMS)
    assert found(ls.search(docs, items, k=2)) == brute(DOCS, ITEMS, 2)
    assert found(ls.search(docs, items, group_bytes=8)) == brute(DOCS, ITEMS)  # a group an item, at most


def test_small_tiles_and_many_partitions(spark, documents, monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    rows = [(int(i) % 90, " ".join(rng.choice(words, 12))) for i in range(120)]
    items = [(i, " ".join(rng.choice(words, 9))) for i in range(20)]
    monkeypatch.setattr(ls, "DOCS", 7)
    want = brute(rows, items, 3)
    assert found(ls.search(documents(rows).repartition(5), items_table(spark, items), k=3)) == want


def test_empty_tables(spark, documents):
    assert found(ls.search(documents([]), items_table(spark, ITEMS))) == set()
    assert found(ls.search(documents(DOCS), items_table(spark, []))) == set()
    out = ls.search(documents([]), items_table(spark, []))
    assert out.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_cuts_keep_partial_sums_exact():
    limit = ls.EXACT // ls.MOST
    item, column = np.array([0, 0, 0, 1]), np.array([0, 1, 2, 2])
    total = np.array([limit - 5, 10, limit, 1])
    parts = ls.cuts(item, column, total, 2, 3)
    assert parts == [(0, 1, True), (1, 2, True), (2, 3, False)]
    assert ls.cuts(np.zeros(5000, int), np.arange(5000), np.ones(5000, int), 1, 5000) == [
        (0, 2048, True), (2048, 4096, True), (4096, 5000, True)]


def test_weights_too_large_for_float64_are_multiplied_as_integers(spark, documents):
    n = ls.EXACT // ls.MOST // 400 + 1  # repeats of one word in an item
    docs = [(i, "big small" if i % 2 else "small other") for i in range(6)]
    items = [(1, "big " * (n // 8)), (2, "small big")]
    many = ls.Items(np.zeros(n * 8, np.int64), np.zeros(n * 8, np.int64), 1, 1)
    (_, _, _, _, parts), = many.tiles(np.array([500]))
    assert parts == [(0, 1, False)]
    assert found(ls.search(documents(docs), items_table(spark, items), group_bytes=64 << 20)) == brute(docs, items)


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    rows = con.execute(f"SELECT item_id, rank, doc_id, score FROM ({ls.OP11_SQL})").fetchall()
    assert found(ls.op11_lexical_search(spark, SMALL)) == set(rows)
