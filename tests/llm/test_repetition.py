import re
from collections import Counter

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.tables import documents  # noqa: F401  a fixture
from tillcast.llm import repetition as rp

SMALL = "/root/testdata/sf0.001"


def brute(text):
    text = text or ""
    words = [(m.start(), m.group()) for m in re.finditer("[^\x20\x09-\x0D]+", text)]
    w = [x for _, x in words]

    def covered(n):
        grams = Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
        return {j for i in range(len(w) - n + 1) if grams[tuple(w[i:i + n])] > 1 for j in range(i, i + n)}

    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    count = Counter(lines)
    chars = sum(map(len, w))
    inside = sum(len(x) for line in lines if count[line] > 1 for x in re.findall("[^\x20\x09-\x0D]+", line))
    share = lambda n: sum(len(w[i]) for i in covered(n)) / max(chars, 1)
    return [len(w), chars, len(re.findall("[#*$%&|<>]", text)), len(lines) - len(count), len(covered(3)),
            *(share(n) for n in rp.MAX_COVERAGE), inside / max(chars, 1)]


def measured(texts):
    return [list(x.values()) for x in rp.measure_column(pa.array(texts, pa.string())).to_pylist()]


WORDS = st.lists(st.sampled_from(["a", "bé", "c#", "\n", " ", "  x", "\t", "日|", "\r", "a b a b c\n"]), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), WORDS), min_size=1, max_size=4))
def test_measures_equal_counting_by_hand(texts):
    for got, text in zip(measured(texts), texts):
        want = brute(text)
        assert got[:5] == want[:5]
        assert all(abs(a - b) < 1e-12 for a, b in zip(got[5:], want[5:]))


def test_verdicts_nulls_long_texts_and_clashing_columns(documents):
    varied = " ".join(f"w{i}" for i in range(300))
    df = documents([(1, varied, "en", "s", 1), (2, "same words here " * 100, "en", "s", 2), (3, None, "en", "s", 3),
                    (4, "short", "en", "s", 4), (5, (varied[:600] + "\n") * 3, "en", "s", 5), (1, varied, "en", "s", 6),
                    (7, " ".join(f"v{i}" for i in range(300_000)), "en", "s", 7)], ", measures int")
    got = sorted((r.doc_id, r.quality.base_failed, r.quality.kept, r.measures) for r in rp.quality(df).collect())
    assert got == [(1, False, True, 1), (1, False, True, 6), (2, True, False, 2), (3, True, False, 3), (4, True, False, 4),
                   (5, True, False, 5), (7, False, True, 7)]
    assert rp.quality(documents([])).count() == 0


def repeating(size, times, total, per_line=0):
    """A text of ``total`` words of four letters with ``times`` passages of ``size`` words that come twice."""
    word = iter(f"{i:04d}" for i in range(10_000))
    twice = [[next(word) for _ in range(size)] for _ in range(times)]
    rest = [next(word) for _ in range(total - 2 * size * times)]
    parts = []
    for p in twice + twice:  # a word of its own behind every passage, so that none goes on into the next
        parts.append(" ".join(p) + (("\n" if per_line else " ") + rest.pop()))
    return ("\n" if per_line else " ").join(parts + rest)


def test_the_method_rejects_documents_that_pass_the_base_rule(documents):
    texts = [repeating(5, 9, 210), repeating(7, 14, 500), repeating(30, 3, 500), repeating(2, 10, 100, per_line=1),
             repeating(5, 8, 210), repeating(7, 13, 500), repeating(17, 5, 500), repeating(2, 8, 100, per_line=1)]
    df = documents(list(enumerate(texts)))
    got = {r.doc_id: r.quality for r in rp.quality(df).collect()}
    assert not any(q.base_failed for q in got.values())
    assert [got[i].kept for i in range(8)] == [False] * 4 + [True] * 4


def test_query_over_the_whole_table(spark):
    got = {r.doc_id: r for r in rp.op5_quality_rules(spark, SMALL).collect()}
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        want, g = brute(r.text), got[r.doc_id]
        assert [g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words] == want[:5]
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert g.base_failed == failed
        over = any(c > m + 1e-9 for c, m in zip(want[5:], [*rp.MAX_COVERAGE.values(), rp.MAX_LINE_COVERAGE]))
        assert g.kept == (not failed and not over)
