import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from tillcast.llm import sentence_pieces as sp

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")
PROC = SentencePieceProcessor(model_file=PATH)
PIECES = sp.Pieces(PATH, sp.ALPHA)


def every(text):
    """All segmentations with their log-weights."""
    lattice = [PIECES.unit(u) for u in sp.units_of(text)]

    def walk(u, i):
        if u == len(lattice):
            yield (), 0.0
            return
        for j, w, ids in lattice[u].edges(i):
            for rest, x in (walk(u + 1, 0) if j == len(lattice[u].text) else walk(u, j)):
                yield ids + rest, w + x
    return dict(walk(0, 0))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="thecat ñ日\n😀", max_size=9), st.integers(-2**63, 2**63 - 1))
def test_samples_are_distinct_segmentations_with_true_probabilities(text, seed):
    paths = every(text)
    total = math.log(sum(math.exp(x) for x in paths.values()))
    got = sp.sample(text, seed, 4, PIECES)
    assert len(got) == min(4, len(paths)) and len({tuple(i) for i, _, _ in got}) == len(got)
    for ids, logp, inclusion in got:
        assert abs(logp - (paths[tuple(ids)] - total)) < 1e-9 and 0 < inclusion <= 1
        assert PIECES.text(ids) == text
    assert got == sp.sample(text, seed, 4, PIECES)
    if len(paths) <= 4:
        assert {i for _, _, i in got} == {1.0}


def test_first_samples_follow_the_distribution_and_weighted_sums_are_unbiased():
    text, n = "the ñ cat", 8000
    paths = every(text)
    total = sum(math.exp(x) for x in paths.values())
    first, weighted = Counter(), []
    for seed in range(n):
        got = sp.sample(text, seed, 3, PIECES)
        first[tuple(got[0][0])] += 1
        weighted.append(sum(math.exp(p) / q * len(ids) for ids, p, q in got))
    for ids, x in paths.items():
        p = math.exp(x) / total
        assert abs(first[ids] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3
    truth = sum(math.exp(x) / total * len(ids) for ids, x in paths.items())
    assert abs(np.mean(weighted) - truth) < 5 * np.std(weighted) / math.sqrt(n)


def test_the_second_sample_is_drawn_without_the_first():
    text, n = "cat", 6000
    paths = every(text)
    total = sum(math.exp(x) for x in paths.values())
    p = {k: math.exp(x) / total for k, x in paths.items()}
    pairs = Counter(tuple(tuple(i) for i, _, _ in sp.sample(text, s, 2, PIECES)) for s in range(n))
    for a in p:
        for b in p:
            if a != b:
                want = p[a] * p[b] / (1 - p[a])
                assert abs(pairs[a, b] / n - want) < 5 * math.sqrt(want / n) + 1e-3


def test_kept_units_change_nothing(monkeypatch):
    small = sp.Pieces(PATH, sp.ALPHA)
    monkeypatch.setattr(sp, "LONGEST", 2)
    monkeypatch.setattr(sp, "KEPT_UNITS", 1)
    text = "the cat sat on the mat, thecatsatonthemat"
    assert sp.sample(text, 5, 3, small) == sp.sample(text, 5, 3, PIECES)


def test_texts_searched_together_give_what_each_gives_alone():
    texts = ["the cat sat on the mat " * 40, "", "日本 the\n😀", "thecatsatonthemat" * 30, "a", "the cat"] * 3
    seeds = list(range(len(texts)))
    for text, seed, got in zip(texts, seeds, sp.samples(texts, seeds, 3, sp.Pieces(PATH, sp.ALPHA))):
        alone = sp.sample(text, seed, 3, PIECES)
        assert [ids.tolist() for ids, _, _ in got] == [ids for ids, _, _ in alone]
        assert np.allclose([g[1:] for g in got], [a[1:] for a in alone], rtol=1e-9, atol=1e-12)


def test_vector_steps_do_not_grow_with_the_number_of_texts(monkeypatch):
    calls, mix = Counter(), sp.mix
    monkeypatch.setattr(sp, "mix", lambda x: (calls.update(mix=1), mix(x))[1])
    texts = [f"the cat sat on the mat {i % 7} " * 30 for i in range(300)]
    drawn = sp.samples(texts, list(range(300)), 3, sp.Pieces(PATH, sp.ALPHA))
    assert calls["mix"] < 100
    take = sp.Pieces.texts
    monkeypatch.setattr(sp.Pieces, "texts", lambda *a: (calls.update(decode=1), take(*a))[1])
    ids = [i.tolist() for rows in drawn for i, _, _ in rows]
    assert sp.texts_of(sp.pa.array([None, *ids], sp.pa.list_(sp.pa.int32())), PIECES) == ["", *(t for t in texts for _ in range(3))]
    assert calls["decode"] == 1


def test_decoding_any_pieces():
    space, e2, x96, x81, a = PROC.piece_to_id("▁"), *(PIECES.byte_id[[0xE2, 0x96, 0x81]].tolist()), PROC.piece_to_id("a")
    for ids, want in [([], ""), ([space], ""), ([a, space], "a "), ([e2, x96, x81, a], "a"), ([a, e2, x96, x81], "a "),
                      ([a, e2, x96, space], "a\ufffd "), ([a, space, x81], "a \ufffd"), ([a, e2], "a\ufffd")]:
        assert PIECES.text(ids) == PIECES.text(np.array(ids, np.int32)) == want


def test_lattice_against_edges_read_off_the_text():
    lattice = sp.Lattice(PIECES)
    units = ["▁", "▁the", "▁ñ日x", "▁😀thecat"]
    (numbers,) = lattice.numbers(["".join(units).replace("▁", " ")[1:]])
    for unit, n in zip(units, numbers):
        def walk(state, at):
            if state == 0:
                assert at == len(unit.encode())
                return {(): 0.0}
            out, total = {}, 0.0
            for e in lattice.edges_of(state):
                total += math.exp(lattice.logp[e])
                piece = int(lattice.id[e])
                for ids, x in walk(lattice.to[e], at + int(PIECES.size[piece])).items():
                    out[piece, *ids] = x + lattice.logp[e]
                rest = sum(math.exp(lattice.logp[f]) for f in lattice.edges_of(state) if f != e)
                assert abs(math.exp(lattice.other[e]) - rest) < 1e-12
            assert abs(total - 1) < 1e-12
            return out

        def read(i):
            if i == len(unit):
                return {(): 0.0}
            return {ids + rest: w + x for j, w, ids in sp.Unit(unit, PIECES).edges(i) for rest, x in read(j).items()}
        want, got = read(0), walk(lattice.first[n], 0)
        total = math.log(sum(map(math.exp, want.values())))
        assert got.keys() == want.keys() and all(abs(got[p] - (want[p] - total)) < 1e-9 for p in want)


def test_clashing_and_repeated_columns(spark):
    df = spark.createDataFrame([(1, "the cat", 5, 6, 7)], "k long, text string, segmentation int, c1 int, seed int")
    got = sp.sampled(df, PATH, ["k"])
    assert got.columns == ["k", "text", "c1", "seed", "segmentation"]
    assert {(r.k, r.text, r.c1, r.seed) for r in got.collect()} == {(1, "the cat", 6, 7)} and got.count() == 3
    twice = df.select("k", "text", F.lit(1).alias("x"), F.lit(2).alias("x"))
    assert sp.sampled(twice, PATH, ["k"]).columns == ["k", "text", "x", "x", "segmentation"]


@pytest.mark.parametrize("text", ["", " ", "  a  ", "日本\n😀", "x" * 20_000, "a b " * 20_000])
def test_odd_and_long_texts(text):
    got = sp.sample(text, 1, 2, PIECES)
    assert all(PIECES.text(ids) == text for ids, _, _ in got) and got


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="thecat ñ日\n😀x", max_size=30))
def test_decoding_equals_the_library_on_its_own_encoding(text):
    assert PIECES.text(PROC.encode(text)) == PROC.decode(PROC.encode(text)) == text


def test_rows_keys_and_clashing_columns(spark):
    rows = [(1, 0, "the cat", 1), (1, 0, "the cat", 2), (2, 0, None, 3), (None, None, "the cat", 4), (3, 1, "", 5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string, sample int")
    got = sp.sampled(df, PATH, ["conv_id", "turn"]).collect()
    by = {}
    for r in got:
        by.setdefault(r.sample, []).append((r.segmentation.sample, r.segmentation.ids, r.segmentation.logp, r.segmentation.inclusion))
    assert by[1] == by[2] != by[4] and len(by[1]) == 3
    assert by[3] == by[5] == [(1, [], 0.0, 1.0)]
    assert sp.sampled(df.limit(0), PATH, ["conv_id", "turn"]).count() == 0
    back = df.select("text", sp.decode(sp.encode(F.col("text"), PATH), PATH).alias("back")).collect()
    assert all(r.back == (r.text or "") for r in back)


def test_query_over_the_whole_table(spark):
    rows = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect()}
    got = sp.op9_sentencepiece(spark, SMALL).collect()
    assert {(r.conv_id, r.turn) for r in got} == set(rows) and all(r.round_trip for r in got)
    key = {(r.conv_id, r.turn): r.k for r in spark.read.parquet(f"{SMALL}/conversations.parquet")
           .select("conv_id", "turn", F.xxhash64("conv_id", "turn").alias("k")).collect()}
    for r in got[:60]:
        ids, logp, inclusion = sp.sample(rows[r.conv_id, r.turn], key[r.conv_id, r.turn], sp.SAMPLES, PIECES)[r.sample - 1]
        assert (r.n_pieces, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert abs(r.logp - logp) < 1e-9 and abs(r.inclusion - inclusion) < 1e-9


def test_the_registered_query_segments_whole_documents(spark):
    from tillcast.llm.queries import QUERIES

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", F.xxhash64("doc_id").alias("k")).collect()
    name = next(n for n in QUERIES if n.startswith("op9_"))
    got = QUERIES[name](spark, SMALL).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in docs} and all(r.round_trip for r in got)
    longest = max(docs, key=lambda r: len(r.text or ""))
    want = sp.sample(longest.text, longest.k, sp.SAMPLES, PIECES)
    assert [(r.n_pieces, r.ids_crc32) for r in sorted((r for r in got if r.doc_id == longest.doc_id), key=lambda r: r.sample)] == [
        (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for ids, _, _ in want]
