import hashlib
import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.tables import documents  # noqa: F401  a fixture
from tillcast.llm import secret_scan as ss

SMALL = "/root/testdata/sf0.001"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    text, out = text or "", []
    # letters in either case means the ASCII ones
    plain = "".join(c if c.isascii() else "\x00" for c in text)
    out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(plain) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 32]
    return [(ss.KINDS[k], s, e) for s, k, e in sorted(out)]


def base(text):
    return [(s["kind"], s["start"], s["end"]) for s in ss.scan_column(pa.array([text], pa.string()))[0].as_py()
            if s["kind"] != "entropy"]


PARTS = st.sampled_from(["password=", "Api_Key : '", "tokenſ=", "apiKEY\":  ", "secret", "=", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef" * 2,
                         "é", " ", "\n", "abc-12345_x", "f", "Z9", "token=secret="])


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS, max_size=12).map("".join))
def test_fixed_kinds_equal_the_patterns(text):
    assert base(text) == brute(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdef0123456789XYZ+/", min_size=20, max_size=70))
def test_windows_equal_entropies_counted_anew(run):
    raw = run.encode()
    limit = ss.THRESHOLD["hex" if set(raw) <= ss._HEX_ANY else "general"]
    covered = set()
    for i in range(len(run) - ss.WINDOW + 1):
        c = Counter(run[i:i + ss.WINDOW])
        if -sum(n / ss.WINDOW * math.log2(n / ss.WINDOW) for n in c.values()) >= limit - 1e-9:
            covered |= set(range(i, i + ss.WINDOW))
    got = set().union(*(range(a, b) for a, b in ss.suspicious(raw)))
    assert got == covered


def kinds(text):
    return [s["kind"] for s in ss.scan_column(pa.array([text]))[0].as_py()]


def test_entropy_finds_random_keys_and_the_allow_list_suppresses():
    key = "zQ8vK2mXr7Lp4TnB6wYc9Hd3"
    assert kinds(f"see {key} there") == ["entropy"]
    assert kinds("see EXAMPLE" + key) == []
    assert kinds("id 1b4e28ba-2fa1-11d2-883f-0016d3cca427 end") == []
    assert kinds("a word of letters onlyandnothingelsewhatever") == []
    assert kinds(f"token={key}") == ["assign"]


@pytest.mark.parametrize("prefix", ["", "auth_", "id-", "sk/", "k=", "+", "key"])
@pytest.mark.parametrize("n, digits", [(24, "0123456789abcdef"), (28, "0123456789abcdef"), (40, "0123456789ABCDEF")])
def test_hex_keys_are_found_behind_a_prefix_as_alone(prefix, n, digits):
    rng = random.Random(5)
    keys = ["".join(rng.choices(digits, k=n)) for _ in range(200)]
    alone = [bool(kinds(f"a {x} b")) for x in keys]
    assert sum(alone) > 190
    assert all(kinds(f"a {prefix}{x} b") or not found for x, found in zip(keys, alone))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abcdef0123456789XYZ+/", min_size=1, max_size=40) | st.text(alphabet="0123456789abcdefABCDEF", min_size=20, max_size=30),
                min_size=1, max_size=4).map("".join))
def test_each_window_has_the_class_of_its_own_characters(run):
    covered = set()
    hexes = [m for m in re.finditer("[0-9A-Fa-f]+", run) if re.search("[0-9]", m[0]) and re.search("[A-Fa-f]", m[0]) or m[0] == run]
    for i in range(len(run) - ss.WINDOW + 1):
        inside = any(m.start() <= i and i + ss.WINDOW <= m.end() for m in hexes)
        limit = ss.THRESHOLD["hex" if inside else "general"]
        c = Counter(run[i:i + ss.WINDOW])
        if -sum(n / ss.WINDOW * math.log2(n / ss.WINDOW) for n in c.values()) >= limit - 1e-9:
            covered |= set(range(i, i + ss.WINDOW))
    assert set().union(*(range(a, b) for a, b in ss.candidates(run.encode()))) == covered


def test_digits_behind_a_prefix_are_no_hex_key():
    assert kinds("order-20231105123987460125") == []


KEY, LONG = "zQ8vK2mXr7Lp4TnB6wYc9Hd3", "wJ4lrXUtnFQMI/K7MDENG/bPxRf1CYzR8vTq2LsK"


def redacted(text):
    return ss.redact_column(pa.array([text]))[0].as_py()


def test_the_allow_list_covers_its_own_part_of_a_run_only():
    for word in ("sample", "example", "dummy", "lorem"):
        assert redacted(f"a {word}/{KEY} b") == f"a {word}[SECRET] b"
        assert redacted(f"a {KEY}_{word} b") == f"a [SECRET]{word} b"
        assert kinds(f"a {word}{KEY} b") == []
    blob = "".join(random.Random(3).sample("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwyz123456789", 60)) * 6
    for filler in ("00000000", "xxxxxxxx", "12345678", "abcdefgh"):
        assert redacted(f"a {blob}{filler}{blob} b") == f"a [SECRET]{filler}[SECRET] b"
    assert redacted(f"{blob}Sample{blob}") == "[SECRET]" + blob[-ss.REACH:] + "Sample" + blob[:ss.REACH] + "[SECRET]"
    assert kinds("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") == []


@pytest.mark.parametrize("fixed", ["AKIA" + "Q7ZP" * 4, "0123456789abcdef" * 2, "token=abcdefgh1"])
@pytest.mark.parametrize("key", [KEY, LONG])
def test_a_key_joined_to_a_fixed_span_goes_too(fixed, key):
    if not fixed.startswith("token"):
        assert redacted(f"é {fixed}/{key} b") == "é [SECRET] b"
        assert redacted(f"é {fixed}_{key} b") == "é [SECRET] b"
    assert redacted(f"é {key}/{fixed} b") == "é [SECRET] b"


def test_redaction_keeps_rows_columns_and_nulls(documents):
    df = documents([(1, "é password=abcdefgh1 x"), (2, None), (3, ""), (1, "é password=abcdefgh1 x"), (None, "clean")], "")
    got = sorted(((r.doc_id, r.text) for r in ss.redact(df).collect()), key=str)
    assert got == sorted([(1, "é [SECRET] x"), (1, "é [SECRET] x"), (2, None), (3, ""), (None, "clean")], key=str)
    assert ss.redact(df).columns == df.columns


def test_spans_with_a_clashing_column_and_an_empty_table(documents):
    df = documents([(1, "x", "en", "s", "kept")], ", secret_spans string")
    assert ss.scan(df, out="found").first()["secret_spans"] == "kept"
    assert ss.scan(documents([])).count() == 0


def test_query_over_the_whole_table(spark):
    got = {r.doc_id: r for r in ss.op6_secret_scans(spark, SMALL).collect()}
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        want = brute(r.text)
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        g = got[r.doc_id]
        assert (g.n_assign, g.n_access, g.n_hex) == tuple(sum(k == x for k, _, _ in want) for x in ss.KINDS[:3])
        assert g.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [x for x in g.spans.split(",") if x and not x.startswith("entropy")] == [x for x in text.split(",") if x]
