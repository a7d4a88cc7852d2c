import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.tables import documents  # noqa: F401  a fixture
from tillcast.llm import shingle_join as sj

SMALL = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """(number of shingles, component) per row, over all pairs of different sets."""
    sets = [shingles(t) for _, t in rows]
    part = list(range(len(rows)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                part[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def joined(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in sj.join(df).collect()), key=str)


def corpus(seed=3, n=140):
    """Groups of copies with some words changed, chains, passages that many share, odd rows."""
    r = random.Random(seed)
    word = lambda: "w%d" % r.randrange(4000)
    rows, hot = [], " ".join(word() for _ in range(60))
    for g in range(12):
        text = [word() for _ in range(r.choice([8, 40, 120]))]
        for _ in range(r.choice([1, 3, 12])):
            copy = list(text)
            for _ in range(r.randrange(0, 4)):
                copy[r.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
            text = copy if g % 3 == 0 else text  # a chain
    rows += [hot + " " + " ".join(word() for _ in range(r.choice([3, 10, 80]))) for _ in range(n - len(rows))]
    rows += ["", None, "  \n", "one", "ONE", "a b c d", "a  B\tc d", "a b c d e", "A b c d e", "x " * 30, "x " * 300]
    return [(i, t) for i, t in enumerate(rows)]


def test_equals_brute_force(documents):
    rows = corpus() + [(7, "again the same id twice here"), (7, "again the same id twice here"), (None, "again the same id twice here"),
                       (None, "only a null id has this text of words")]
    assert joined(documents(rows)) == sorted(brute(rows), key=str)


@pytest.mark.parametrize("block", [60, 700])
def test_components_larger_than_a_block_lose_no_link(documents, monkeypatch, block):
    monkeypatch.setattr(sj, "BLOCK", block)
    monkeypatch.setattr(sj, "SHARD", 900)
    rows = corpus(5)
    assert joined(documents(rows)) == sorted(brute(rows), key=str)


def test_blocks_find_the_same_components_for_any_choice_of_l(monkeypatch):
    r = np.random.default_rng(1)
    base = r.integers(0, 400, 60)
    tokens = []
    for _ in range(80):
        x = base.copy() if r.random() < 0.5 else r.integers(0, 400, 60)
        x[r.integers(0, 60, r.integers(0, 12))] = r.integers(0, 400)
        tokens.append(np.unique(x))
    tokens.sort(key=len)
    n = np.array([len(x) for x in tokens])
    want = [{j for j in range(80) if 100 * len(np.intersect1d(tokens[i], tokens[j])) >= 75 * len(np.union1d(tokens[i], tokens[j]))} for i in range(80)]
    for mu in (1e-9, 0.0085, 0.3, 50.0):
        monkeypatch.setattr(sj, "MU", mu)
        block = sj.Block(n, tokens)
        for i in range(80):
            for j in block.query(i):
                assert j in want[i]
        assert all(block.label[i] == block.label[j] for i in range(80) for j in want[i])


def test_hot_classes_and_an_empty_table(documents):
    rows = [(i, "every third row is this very text of some words") for i in range(300)] + corpus(9, 40)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    assert joined(documents(rows)) == sorted(brute(rows), key=str)
    assert joined(documents([])) == []


def test_one_of_each_keeps_clean_empty_and_first_rows(documents):
    rows = [(9, "the same words are in this one"), (4, "The same words are in this one"), (4, "The same words are in this one"),
            (4, "the same words are in  this one"), (None, "the same words are in this one"), (1, ""), (2, None), (1, ""), (3, "a clean text"),
            (None, "a null id alone keeps one row"), (None, "a null id alone keeps one row")]
    df = documents([(*r, "en", "s", 1) for r in rows], ", kept_id int")
    kept = sj.one_of_each(df)
    assert kept.columns == df.columns
    got = Counter((r.doc_id, (r.text or "").lower().replace("  ", " ")) for r in kept.collect())
    assert got == Counter([(4, "the same words are in this one"), (1, ""), (1, ""), (2, ""), (3, "a clean text"),
                           (None, "a null id alone keeps one row")])


def test_a_long_text_is_read_whole():
    a = "w%d "
    text = "".join(a % i for i in range(400_000))
    n = sj.class_column(pa.array([text, text + "more", text])).to_pylist()
    assert [x["n"] for x in n] == [399_996, 399_997, 399_996] and n[0] == n[2] != n[1]


def test_query_over_the_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in sj.op3_ngram_jaccard(spark, SMALL).collect())
    assert got == sorted(brute(rows))
