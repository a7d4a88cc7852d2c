"""Every stage against plain Python on its own input."""

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline as cp
from tests.llm.test_line_dedup import brute as lines_by_hand
from tests.llm.test_packing import check
from tests.llm.test_shingle_join import brute as groups_by_hand
from tests.llm.tables import documents  # noqa: F401  a fixture
from tillcast.llm import line_dedup, packing, secret_scan

MID = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_the_stages_are_the_named_ones_in_order():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "secret scans", "packing"]
    assert cp.ORACLE_SQL is None


def test_stages_one_after_the_other(spark):
    docs = cp.table(spark, MID, "documents")
    flags = {r.doc_id: r.toxic for r in cp.table(spark, MID, "labels").collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    for name, stage in cp.STAGES:
        out = cp.written(stage(spark, docs, MID))
        got = out.collect()
        if name == "packing":
            check(pd.DataFrame(got, columns=out.columns), [(r.doc_id, r.text) for r in rows.values()], packing.CAPACITY)
            break
        assert out.columns == COLUMNS and len({r.doc_id for r in got}) == len(got)
        kept = {r.doc_id: r for r in got}
        if name == "toxicity":
            assert all(kept[d].text == rows[d].text for d in kept)
            assert np.mean([d in kept for d, t in flags.items() if t == 1]) < 0.1
            assert np.mean([d in kept for d, t in flags.items() if t == 0]) > 0.99
        if name == "line dedup":
            want = {d: t for d, _, removed, t in lines_by_hand(
                [(r.doc_id, r.text, r.source) for r in rows.values()], line_dedup.MIN_SITES) if not removed or t.replace("\n", " ").strip(" ")}
            assert {d: r.text for d, r in kept.items()} == want
        if name == "n-gram Jaccard join":
            assert set(kept) == {d for d, n, c in groups_by_hand([(r.doc_id, r.text) for r in rows.values()]) if n == 0 or d == c}
            assert all(kept[d] == rows[d] for d in kept)
        if name == "secret scans":
            assert set(kept) == set(rows)
            assert [d for d in kept if any(s["kind"] != "entropy" and s["end"] - s["start"] > 40 for s in spans(kept[d].text))] == []
            assert all(kept[d].text == rows[d].text for d in kept if not spans(rows[d].text))
        rows, docs = kept, out


def spans(text):
    import pyarrow as pa

    return secret_scan.scan_column(pa.array([text], pa.string()))[0].as_py()


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (2, ""), (None, "x"), (3, "a b c d e f g")]])
def test_odd_tables_pass_every_stage(spark, documents, rows):
    docs = documents([(*r, "en", "s", "kept") for r in rows], ", cut string")
    for name, stage in cp.STAGES:
        docs = cp.written(stage(spark, docs, MID))
    assert docs.count() == len(rows) and docs.columns[-1] == "offset"


def test_run_gives_the_last_stage(spark):
    assert cp.run(spark, "/root/testdata/sf0.001").columns == [
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
