import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.tables import documents  # noqa: F401  a fixture
from tillcast.llm import language_id as li
from tillcast.llm.textbuf import chunks

MID = "/root/testdata/sf0.01"


def counted(texts):
    (chunk,) = chunks(pa.array(texts))
    gram, n = np.unique(li.four_grams(chunk)[0], return_counts=True)
    return pa.table({"lang": ["x"] * len(gram), "gram": gram.astype(np.int32), "n": n})


def test_grams_end_at_each_symbol_and_stay_in_a_text():
    chunks_ = list(chunks(pa.array(["A b!!c", None, "", "é", "12", "ab"])))
    gram, doc, letters = li.four_grams(chunks_[0])
    text = lambda g: "".join(" abcdefghijklmnopqrstuvwxyz"[g >> s & 63] if (g >> s & 63) < 27 else "*" for s in (18, 12, 6, 0))
    assert [(d, text(int(g))) for d, g in zip(doc, gram)] == [
        (0, "   a"), (0, "  a "), (0, " a b"), (0, "a b "), (0, " b c"), (3, "   *"), (5, "   a"), (5, "  ab")]
    assert letters.tolist() == [3, 0, 0, 1, 0, 2]


def test_probabilities_of_a_context_sum_to_one_and_follow_kneser_ney():
    row = li.train(counted(["abacabadabacaba abc cab", "san francisco", "dab cab bad"])).to_pylist()[0]
    model = li.Model([row])
    grams = np.arange(1 << 24, dtype=np.uint32).reshape(-1, 64)
    for context in (0, 1, 1 << 6 | 2, (1 << 12) | (2 << 6) | 1, 77_777, li.CONTEXTS - 1):
        g = grams[context]
        at = np.searchsorted(model.gram, g)
        known = model.gram[np.minimum(at, len(model.gram) - 1)] == g
        logp = np.where(known, model.p4[np.minimum(at, len(model.gram) - 1), 0],
                        model.weight[context, 0] + model.p3[g & (li.CONTEXTS - 1), 0])
        assert abs(np.exp(logp.astype(float)).sum() - 1) < 1e-4


def test_cross_entropy_equals_a_dictionary_model():
    texts = ["the cat sat on the mat", "a hat and a cat"]
    table = counted(texts)
    model = li.Model([li.train(table).to_pylist()[0]])
    p = dict(zip(model.gram.tolist(), model.p4[:, 0].tolist()))
    (chunk,) = chunks(pa.array(["the bat sat", "zzz qqq"]))
    gram, doc, _ = li.four_grams(chunk)
    want = np.zeros(2)
    for g, d in zip(gram.tolist(), doc):
        want[d] -= p.get(g, float(model.weight[g >> 6, 0] + model.p3[g & (li.CONTEXTS - 1), 0]))
    h, _ = model.cross_entropy(chunk)
    assert np.allclose(h[:, 0], want / np.bincount(doc), atol=1e-5)


def test_calibration_is_a_maximum():
    r = np.random.default_rng(0)
    lead, letters = r.exponential(0.05, 4000), r.integers(5, 500, 4000).astype(float)
    right = (r.random(4000) < 1 / (1 + np.exp(-(0.5 + 2 * lead * np.sqrt(letters))))).astype(float)
    a, b, c = li.calibrate(lead, letters, right)
    assert abs(b - 2) < 0.6 and abs(a + c * np.log(200) - 0.5) < 0.4
    assert all(np.isfinite(li.calibrate(lead, letters, np.ones(4000))))


def test_undetermined_texts_nulls_and_clashing_columns(spark, documents):
    learn = [(i, "der und die das ist nicht" if i % 2 else "the and of this is not", "de" if i % 2 else "en") for i in range(60)]
    rows = learn + [(1001, None, "en"), (1002, "", None), (1003, "12 !?", "de"), (None, "der und die", "xx"), (1004, "und die " * 50_000, None), (1, learn[1][1], "de")]
    df = documents([(*r, "s", "kept") for r in rows], ", best string")
    got = li.identify(df).collect()
    assert len(got) == len(rows) and {r.best for r in got} == {"kept"}
    for r in got:
        x = r.language
        if not any(ch.isalpha() for ch in r.text or ""):
            assert x.lang_pred == "und" and x.score == 0.0
        else:
            assert x.lang_pred == ("de" if "und" in r.text or "der" in r.text else "en") and 0 <= x.score <= 1
        assert x.held_out is not None
    assert li.identify(documents([])).count() == 0
    none = li.identify(documents([(1, "abc", None)])).first().language
    assert (none.lang_pred, none.score) == ("und", 0.0)


def test_held_out_accuracy_and_fold(spark):
    import zlib

    docs = spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "lang")
    got = li.op7_language_id(spark, MID).join(docs, "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_labels_and_sources_are_no_inputs(spark, documents):
    learn = [(i, "der und die das ist nicht" if i % 2 else "the and of this is not", "de" if i % 2 else "en") for i in range(60)]
    a = li.identify(documents(learn)).select("doc_id", "language").collect()
    held = {r.doc_id for r in a if r.language.held_out}
    b = li.identify(documents([(i, t, "zz" if i in held else lang) for i, t, lang in learn])).select("doc_id", "language").collect()
    assert sorted(a) == sorted(b)
