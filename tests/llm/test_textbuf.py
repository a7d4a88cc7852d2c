import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tillcast.llm.textbuf import CHUNK_BYTES, LOWER, chunks, windows

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n\x0b\x1c.日 ", max_size=40)), max_size=8)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 60))
def test_words_equal_the_pattern_in_any_chunking(texts, limit):
    got = [None] * len(texts)
    for c in chunks(pa.array(texts, pa.string()), limit=limit):
        starts, ends = c.words
        for i in range(c.n):
            a, b = c.word_bounds[i], c.word_bounds[i + 1]
            got[c.first + i] = [c.data[s:e].tobytes().decode() for s, e in zip(starts[a:b], ends[a:b])]
    assert got == [re.findall("[^\x20\x09-\x0D]+", t or "") for t in texts]


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_hashes_tell_words_apart_and_follow_their_bytes(texts):
    seen = {}
    for limit in (7, CHUNK_BYTES):
        for c in chunks(pa.array(texts, pa.string()), limit=limit):
            starts, ends = c.words
            for s, e, h in zip(starts, ends, c.hasher(LOWER)(starts, ends)):
                assert seen.setdefault(c.data[s:e].tobytes().lower(), h) == h
    assert len(set(seen.values())) == len(seen)


def test_windows_stay_inside_a_text():
    h, doc = np.arange(1, 8, dtype=np.uint64), np.array([0, 0, 0, 1, 1, 1, 1])
    keys, at = windows(h, doc, 3)
    assert at.tolist() == [0, 3, 4] and len(set(keys.tolist())) == 3


def test_a_slice_and_a_text_longer_than_a_chunk():
    a = pa.array(["x", "a b " * CHUNK_BYTES, None, "z"]).slice(1)
    assert [int(np.diff(c.word_bounds).sum()) for c in chunks(a)] == [2 * CHUNK_BYTES, 1]
