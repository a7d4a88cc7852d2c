import hashlib
import re

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.tables import documents  # noqa: F401  a fixture
from tillcast.llm import decontaminate as dc
from tillcast.llm.fm_index import Index, Wavelet

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - 9, 1) if w else 0):
            windows.setdefault(tuple(w[k:k + 10]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, named = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k:k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    named |= own
        text = ",".join(sorted(str(i) for i in named if i is not None))
        out.append((d, len(w), len(hit), len(named), hashlib.sha256(text.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def digest(found):
    rows = []
    for r in found.collect():
        f = r["found"]
        spans = [(s["start"], s["end"]) for s in f["spans"]]
        assert all(a < b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))  # apart and in order
        text = ",".join(sorted(i for i in f["items"] if i is not None))
        rows.append((r["doc_id"], f["n_words"], sum(b - a for a, b in spans), len(f["items"]),
                     hashlib.sha256(text.encode()).hexdigest(), bool(spans)))
    return sorted(rows, key=repr)


def items_table(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


PASSAGE = "One two three four five six seven eight nine ten eleven twelve"
ITEMS = [(10, PASSAGE), (9, "short item"), (10, "école É x1"), (4, None), (5, "..."), (None, "no name here"), (6, "Short. ITEM"),
         (7, "a a a a a a a a a a a a")]
DOCS = [(1, f"before {PASSAGE} after"), (2, PASSAGE.replace("six", "sax")), (3, "one TWO_three-four five six, seven eight nine\nten eleven"),
        (4, None), (5, ""), (6, "short item short item short"), (7, "x short"), (8, "item y"), (9, "a " * 40 + "b " + "a " * 9),
        (9, "a " * 40 + "b " + "a " * 9), (None, "there is no name here"), (11, "école É X1!"),
        (12, " ".join(f"{PASSAGE} filler{i}" for i in range(3000))), (13, f"{PASSAGE} {PASSAGE}"), (14, "?? !!")]


def test_windows_spans_and_items_against_brute_force(spark, documents):
    docs = documents(DOCS).selectExpr("*", "'x' AS found", "5 AS item_id", "1 AS part")
    for group_bytes in (None, 30):  # one group, and several that are merged
        got = dc.find(docs, items_table(spark, ITEMS), group_bytes=group_bytes)
        assert digest(got.repartition(3)) == brute(DOCS, ITEMS)


def test_small_shards_and_copies(spark, documents, monkeypatch):
    rng = np.random.default_rng(5)
    vocabulary = ["aa", "bb", "cc", "dd"]
    items = [(i, " ".join(rng.choice(vocabulary, 12))) for i in range(30)]
    rows = [(i, " ".join(rng.choice(vocabulary, 30)) + " " + items[i % 30][1]) for i in range(40)]
    rows += [(100 + i, rows[3][1]) for i in range(50)]
    monkeypatch.setattr(dc, "SHARD", 64)
    known = type("B", (), {"value": None})()
    import pyarrow as pa

    from tillcast.llm.item_groups import item_terms
    group = pa.table({"id": [i for i, _ in items], "text": [t for _, t in items]})
    ids, row, hashes = item_terms(group)
    known.value = (ids.cast(pa.string()), dc.Patterns(np.arange(30), row, hashes))
    got = dc.finder(known)(pa.array([t for _, t in rows])).to_pylist()
    for (d, n, hit, many, _, bad), f in zip(sorted(brute(rows, items), key=lambda r: r[0]), got):
        assert (f["n_words"], sum(s["end"] - s["start"] for s in f["spans"]), len(f["items"])) == (n, hit, many) and bad


def test_remove_cuts_the_spans_out(spark, documents):
    docs = documents([(1, f"Before, {PASSAGE}. After"), (2, "clean"), (3, None), (4, "é short  item ü")]).selectExpr("*", "1 AS found")
    out = dc.remove(docs, items_table(spark, ITEMS))
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "Before,  . After", 2: "clean", 3: None, 4: "é   ü"}


def test_empty_tables(spark, documents):
    assert dc.find(documents([]), items_table(spark, ITEMS)).count() == 0
    assert digest(dc.find(documents(DOCS[:4]), items_table(spark, []))) == brute(DOCS[:4], [])
    assert digest(dc.find(documents(DOCS[:4]), items_table(spark, [(1, None), (2, "")]))) == brute(DOCS[:4], [])


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    names = "doc_id, n_words, n_hit, n_items, items_sha256, contaminated"
    want = con.execute(f"SELECT {names} FROM ({dc.OP13_SQL})").fetchall()
    got = [tuple(r) for r in dc.op13_decontaminate(spark, SMALL).selectExpr(*names.split(", ")).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@given(st.lists(st.lists(st.integers(1, 5), max_size=30), min_size=1, max_size=8), st.lists(st.lists(st.integers(1, 7), min_size=1, max_size=4), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_index_counts_and_locates(runs, patterns):
    text = np.array([x for r in runs for x in [*r, 0]])
    index = Index(text)
    length = np.array([len(p) for p in patterns])
    rows = np.zeros((len(patterns), int(length.max())), int)
    for i, p in enumerate(patterns):
        rows[i, :len(p)] = p
    low, high = index.count(rows, length)
    for p, a, b in zip(patterns, low, high):
        places = [i for i in range(len(text) - len(p) + 1) if text[i:i + len(p)].tolist() == p]
        assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == places


@given(st.lists(st.integers(0, 12), max_size=300))
@settings(max_examples=60, deadline=None)
def test_wavelet_rank_and_access(symbols):
    s = np.array(symbols, np.int64)
    wavelet = Wavelet(s, 4)
    at = np.arange(len(s) + 1)
    for c in range(16):
        assert wavelet.rank(np.full(len(at), c), at).tolist() == [symbols[:i].count(c) for i in at]
    got, before = wavelet.access(np.arange(len(s)))
    assert got.tolist() == symbols and before.tolist() == [symbols[:i].count(c) for i, c in enumerate(symbols)]
