import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.tables import documents  # noqa: F401  a fixture
from tillcast.llm import packing as pk
from tillcast.llm.textbuf import chunks

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
ODD = ["Hello's WORLD it's 123 a1b2", "<|endoftext|> foo<|startoftext|>bar", "İstanbul ΣΑΣ ﬁ école ÉCOLE ŉ", "x\x85y \x1cq a\xa0b 你好。",
       "naïve’s ¿qué? ½ ² ×÷", "", " \n\t", None, "x" * 3000, "é ́ ſ"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aZ'sé İ́.1<|>\x1c\x85日\n#", max_size=25), max_size=6))
def test_ids_equal_the_tokenizer(texts):
    enc = pk.encoder(PATH)
    for texts in (texts, ODD):
        for c in chunks(pa.array(texts, pa.string()), limit=64):
            ids, at = enc.encode(c)
            for i in range(c.n):
                assert ids[at[i]:at[i + 1]].tolist() == WHOLE.encode(texts[c.first + i] or "", add_special_tokens=False).ids


def test_a_full_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(pk, "CACHE", 3)
    enc = pk.Encoder(PATH)
    texts = ["a b c d e", "f g a b", "h a", "a b c d e"]
    for c in chunks(pa.array(texts), limit=1):
        assert enc.encode(c)[0].tolist() == WHOLE.encode(texts[c.first], add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_tournament_is_first_fit(lengths):
    lengths = sorted(lengths, reverse=True)
    room, want = [], []
    for n in lengths:
        at = next((i for i, r in enumerate(room) if r >= n), len(room))
        if at == len(room):
            room.append(50)
        room[at] -= n
        want.append(at)
    assert pk.first_fit_decreasing(lengths, 50) == want


def check(pieces: pd.DataFrame, texts: list, capacity: int):
    """Every id once, with its checksum; offsets without gaps; no sequence too long."""
    want = []
    for doc_id, text in texts:
        ids = np.array([*WHOLE.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        for a in range(0, len(ids), capacity):
            part = ids[a:a + capacity]
            want.append((doc_id, a, len(part), zlib.crc32(part.tobytes()), len(ids)))
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    got = [tuple(None if pd.isna(x) else int(x) for x in r) for r in pieces[cols].itertuples(index=False)]
    assert sorted(got, key=str) == sorted(want, key=str)
    for _, s in pieces.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *np.cumsum(s["length"])[:-1]] and s["length"].sum() <= capacity


def test_groups_cuts_nulls_and_repeats(documents):
    rows = [(i, "word " * (i % 37)) for i in range(200)] + [(None, "no id"), (5, "again"), (5, "again"), (300, None), (301, ""), (302, "long text " * 400)]
    got = pk.pack(documents(rows), PATH, capacity=64, group_docs=50).toPandas()
    check(got, rows, 64)
    full = got.groupby("sequence_id")["length"].sum()
    assert full.sum() / (64 * len(full)) > 0.9
    assert pk.pack(documents([]), PATH).count() == 0


def test_query_over_the_whole_table(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    check(pk.op10_packing(spark, SMALL).toPandas(), [(r.doc_id, r.text) for r in rows], pk.CAPACITY)
