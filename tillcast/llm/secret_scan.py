"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

Fixed patterns (kinds ``assign``, ``access``, ``hex``) are matched on the whole text.
The method adds spans of kind ``entropy``: in every run of 20 or more key characters
that mixes letters and digits, a window slides by one character at a time; the counts of
its characters, and with them the sum of c*log2(c), change by the one character that
enters and the one that leaves. A window is suspicious when its Shannon entropy reaches
the threshold of its character class: general, or hexadecimal inside a stretch of 20 or
more hexadecimal digits that mixes letters and digits, whatever the rest of the run is;
overlapping suspicious windows are one span. Windows that overlap a fixed-pattern span, or
what the allow-list covers, are left out; the rest of the run is scanned all the same.

Cases: a null or empty text has no spans; ties of start are ordered as the kinds are
listed; repeated rows give equal results each; a very long text is scanned whole, in time
linear in its length. Spans count code points, end exclusive.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.llm.shared import fresh, ship, table
from tillcast.llm.textbuf import IS_LEAD, Chunk, chunks

KINDS = ("assign", "access", "hex", "entropy")
SPAN_TYPE = "array<struct<kind:string,start:bigint,end:bigint>>"

ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_WORDS = (b"passw", b"secret", b"token", b"api")

#: Window length, and the entropy in bits from which a window of a class is suspicious:
#: a random window of 20 has about 3.5 bits over 16 digits and 4.1 over 62 characters;
#: lower-case words stay under 3.6.
WINDOW = 20
THRESHOLD = {"hex": 3.0, "general": 3.85}
#: What is no secret: sample keys and placeholders, UUIDs, names and numbers in series. A word also
#: covers the characters joined to it without a sign between, at most REACH on either side.
ALLOW = re.compile(
    rb"(?i)(example|sample|placeholder|changeme|dummy|lorem)|x{6,}|0{8,}|12345678|abcdefgh"
    rb"|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
SIGNS = frozenset(b"+/_=-")
REACH = 40

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_KEY = np.zeros(256, bool)
_KEY[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = True
_HEX_ANY = frozenset(b"0123456789abcdefABCDEF")
_HEX_STRETCH = re.compile(rb"[0-9A-Fa-f]{%d,}" % WINDOW)
_FREE = re.compile(rb"\0{%d,}" % WINDOW)
_MIX = re.compile(rb"[0-9][A-Fa-f]|[A-Fa-f][0-9]")
_CLOG = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def _runs(chunk: Chunk, member: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the maximal runs of member bytes within one text, at least so long."""
    starts, ends = chunk.runs(member)
    long = ends - starts >= least
    return starts[long], ends[long]


def suspicious(run: bytes, kind: str = "") -> list[tuple[int, int]]:
    """Ranges of a candidate run that windows of high entropy cover, for one class of all windows
    (by default the run's)."""
    limit = THRESHOLD[kind or ("hex" if _HEX_ANY.issuperset(run) else "general")]
    most = (math.log2(WINDOW) - limit) * WINDOW  # largest sum of c*log2(c) of a suspicious window
    count = [0] * 256
    total = 0.0
    for b in run[:WINDOW]:
        total += _CLOG[count[b] + 1] - _CLOG[count[b]]
        count[b] += 1
    out: list[list[int]] = []
    for end in range(WINDOW, len(run) + 1):
        if total <= most + 1e-9:
            if out and out[-1][1] >= end - WINDOW:
                out[-1][1] = end
            else:
                out.append([end - WINDOW, end])
        if end < len(run):
            gone, come = run[end - WINDOW], run[end]
            total += _CLOG[count[gone] - 1] - _CLOG[count[gone]]
            count[gone] -= 1
            total += _CLOG[count[come] + 1] - _CLOG[count[come]]
            count[come] += 1
    return [(a, b) for a, b in out]


def candidates(run: bytes, taken: bytearray | None = None) -> list[tuple[int, int]]:
    """Ranges of a run that suspicious windows cover, each window by its own class; windows with a
    byte that is marked in ``taken`` are left out."""
    pieces = [(0, len(run))] if taken is None else [m.span() for m in _FREE.finditer(taken)]
    if _HEX_ANY.issuperset(run):
        return [(i + a, i + b) for i, j in pieces for a, b in suspicious(run[i:j], "hex")]
    found = [(i + a, i + b) for i, j in pieces for a, b in suspicious(run[i:j], "general")]
    general = len(found)
    for i, j in pieces:
        for m in _HEX_STRETCH.finditer(run, i, j):
            if _MIX.search(m[0]):
                found += [(m.start() + a, m.start() + b) for a, b in suspicious(m[0], "hex")]
    if len(found) == general:
        return found
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and out[-1][1] >= a:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def _allow(run: bytes, taken: bytearray | None) -> bytearray | None:
    """The bytes of a run that are taken, with those that the allow-list covers; None: no byte."""
    for m in ALLOW.finditer(run):
        a, b = m.span()
        if m[1]:
            first, last = max(0, a - REACH), min(len(run), b + REACH)
            while a > first and run[a - 1] not in SIGNS:
                a -= 1
            while b < last and run[b] not in SIGNS:
                b += 1
        if taken is None:
            taken = bytearray(len(run))
        taken[a:b] = b"\1" * (b - a)
    return taken


def _scan_chunk(chunk: Chunk) -> list[list[tuple[int, int, int]]]:
    """Per text its (start byte, kind number, end byte), ordered."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(chunk.n)]
    marked = np.zeros(len(chunk.data) + 1, np.int64)  # coverage of the fixed spans, as differences

    def add(doc: int, start: int, kind: int, end: int) -> None:
        found[doc].append((start, kind, end))
        if kind < 3:
            marked[chunk.bounds[doc] + start] += 1
            marked[chunk.bounds[doc] + end] -= 1

    for i in range(chunk.n):
        text = chunk.text(i)
        low = text.lower()
        if any(word in low for word in ASSIGN_WORDS):
            for m in ASSIGN.finditer(text):
                if m.end(2) - m.start(2) >= 8:
                    add(i, m.start(), 0, m.end())
        if b"AKIA" in text:
            for m in ACCESS.finditer(text):
                if m.end() - m.start() >= 16:
                    add(i, m.start(), 1, m.end())
    for s, e in zip(*(x.tolist() for x in _runs(chunk, _HEX, 32))):
        i = int(np.searchsorted(chunk.bounds, s, side="right")) - 1
        add(i, s - int(chunk.bounds[i]), 2, e - int(chunk.bounds[i]))

    starts, ends = _runs(chunk, _KEY, WINDOW)
    if len(starts):
        taken = np.cumsum(marked)[:-1] > 0
        digits, letters, fixed = (np.concatenate(([0], np.cumsum(x))) for x in (
            _DIGIT[chunk.data], _ALPHA[chunk.data], taken))
        mixed = (digits[ends] > digits[starts]) & (letters[ends] > letters[starts])
        for s, e in zip(starts[mixed].tolist(), ends[mixed].tolist()):
            run = chunk.data[s:e].tobytes()
            i = int(np.searchsorted(chunk.bounds, s, side="right")) - 1
            for a, b in candidates(run, _allow(run, bytearray(taken[s:e].tobytes()) if fixed[e] > fixed[s] else None)):
                add(i, s + a - int(chunk.bounds[i]), 3, s + b - int(chunk.bounds[i]))
    for i, spans in enumerate(found):
        if spans:
            spans.sort()
            lo, hi = chunk.bounds[i], chunk.bounds[i + 1]
            lead = IS_LEAD[chunk.data[lo:hi]]
            if not lead.all():  # byte offsets to code points
                at = np.concatenate(([0], np.cumsum(lead)))
                found[i] = [(int(at[s]), k, int(at[e])) for s, k, e in spans]
    return found


def scan_column(text: pa.Array) -> pa.Array:
    """Spans of every text of an Arrow column."""
    size, kind, start, end = [0], [], [], []
    for chunk in chunks(text):
        for spans in _scan_chunk(chunk):
            size.append(size[-1] + len(spans))
            for s, k, e in spans:
                kind.append(KINDS[k])
                start.append(s)
                end.append(e)
    fields = [pa.array(kind, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())]
    return pa.ListArray.from_arrays(pa.array(size, pa.int32()),
                                    pa.StructArray.from_arrays(fields, ["kind", "start", "end"]))


def secret_spans(text: Column | str) -> Column:
    """Column of all spans of a text column, ordered by start, then kind."""
    return F.arrow_udf(scan_column, SPAN_TYPE)(text)


def redact_column(text: pa.Array) -> pa.Array:
    """Every text with each maximal covered range replaced by ``[SECRET]``."""
    out = []
    for chunk in chunks(text):
        for i, spans in enumerate(_scan_chunk(chunk)):
            raw = chunk.text(i).decode("utf-8")
            if spans:
                parts, at, i_end = [], 0, -1
                for s, _, e in spans:
                    if s > i_end:
                        parts += [raw[at:s], "[SECRET]"]
                    i_end = max(i_end, e)
                    at = i_end
                raw = "".join(parts) + raw[at:]
            out.append(raw)
    return pa.array([None if null else x for x, null in zip(out, text.is_null().to_pylist())], pa.string())


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with secrets replaced; all columns and rows stay, a null text stays null."""
    ship(docs.sparkSession)
    return docs.withColumn(text, F.arrow_udf(redact_column, "string")(F.col(text)))


def scan(docs: DataFrame, text: str = "text", out: str = "secret_spans") -> DataFrame:
    """The documents with a column of spans."""
    ship(docs.sparkSession)
    return docs.withColumn(out, secret_spans(F.col(text)))


def span_string(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    (spans,) = fresh(docs, "spans")
    found = scan(docs, "text", spans).select("doc_id", spans)
    base = F.filter(spans, lambda s: s["kind"] != "entropy")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(span_string(base), 256).alias("base_sha256"),
                        span_string(F.col(spans)).alias("spans"))
