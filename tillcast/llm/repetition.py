"""Quality rules: base counts, and how much of a text lies in repeated passages.

All windows of one length are hashed at once (rolling over the word hashes of a chunk of
texts); equal hashes within a text are found by one sort. For each n-gram length the
measure is the share of word characters (code points) that lie in n-grams seen before or
again in the text; for lines, the share in lines with a word that equal another line.

Cases: a null or empty text has no words, all counts 0, and fails the base rule; a text of
fewer than n words has no n-grams; repeated rows give equal results each; texts are read
whole, in memory linear in the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.llm.shared import columns, fresh, ship, table
from tillcast.llm.textbuf import IS_LEAD, Chunk, chunks, mix, range_sums, windows

#: Largest share of word characters allowed inside repeated n-grams of a length, and lines. Words in
#: repeated 5-, 7- or 10-grams are in repeated 3-grams too, of which the base rule allows 50 %, so
#: only limits below that say more than it.
MAX_COVERAGE = {5: 0.40, 7: 0.38, 10: 0.35}
MAX_LINE_COVERAGE = 0.35
MIN_WORDS = 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

FIELDS = (["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
          [f"cover_{n}" for n in MAX_COVERAGE] + ["cover_lines"])
TYPE = "struct<" + ",".join([f"{f}:bigint" for f in FIELDS[0]] + [f"{f}:double" for f in FIELDS[1]]) + ">"


def _repeated(keys: np.ndarray) -> np.ndarray:
    """True for every key that occurs twice or more."""
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return twice[at] == keys


def _covered(hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """True for every word in an n-word window found twice or more in its text."""
    keys, at = windows(hashes, doc, n)
    first = at[_repeated(mix(keys + doc[at].astype(np.uint64)))]
    steps = np.zeros(len(hashes) + 1, np.int32)
    np.add.at(steps, first, 1)
    np.add.at(steps, first + n, -1)
    return np.cumsum(steps)[:-1] > 0


def _lines(chunk: Chunk, hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per line with a word: its text number, first byte, and a hash that tells lines apart."""
    if not len(chunk.data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    nonempty = chunk.bounds[:-1][np.diff(chunk.bounds) > 0]
    after_break = np.flatnonzero(chunk.data == 10) + 1
    starts = np.union1d(nonempty, after_break[after_break < len(chunk.data)])
    stops = np.append(starts[1:], len(chunk.data))
    ends = stops - ((stops > starts) & (chunk.data[stops - 1] == 10))
    with_word = np.diff(np.searchsorted(chunk.words[0], np.append(starts, len(chunk.data)))) > 0
    starts, ends = starts[with_word], ends[with_word]
    doc = np.searchsorted(chunk.bounds, starts, side="right") - 1
    return doc, starts, mix(hasher(starts, ends) + doc.astype(np.uint64))


def measure(chunk: Chunk) -> list[np.ndarray]:
    """The values of FIELDS for the texts of a chunk."""
    starts, ends = chunk.words
    hasher = chunk.hasher()
    hashes, doc, wb = hasher(starts, ends), chunk.word_doc, chunk.word_bounds
    chars = np.concatenate(([0], np.cumsum(IS_LEAD[chunk.data])))
    size = chars[ends] - chars[starts]
    total = range_sums(size, wb)
    line_doc, line_at, line_key = _lines(chunk, hasher)
    n_lines = np.bincount(line_doc, minlength=chunk.n)
    _, one = np.unique(line_key, return_index=True)
    n_unlike = np.bincount(line_doc[one], minlength=chunk.n)

    def share(inside: np.ndarray) -> np.ndarray:
        return range_sums(size * inside, wb) / np.maximum(total, 1)

    counts = [np.diff(wb), total, range_sums(_SYMBOL[chunk.data], chunk.bounds),
              n_lines - n_unlike, range_sums(_covered(hashes, doc, 3), wb)]
    cover = [share(_covered(hashes, doc, n)) for n in MAX_COVERAGE]
    again = _repeated(line_key)
    word_line = np.searchsorted(line_at, starts, side="right") - 1
    cover.append(share(again[word_line] if len(again) else np.zeros(len(starts), bool)))
    return counts + cover


def measure_column(text: pa.Array) -> pa.Array:
    parts = [measure(c) for c in chunks(text)]
    names = FIELDS[0] + FIELDS[1]
    types = [pa.int64()] * len(FIELDS[0]) + [pa.float64()] * len(FIELDS[1])
    cols = [pa.array(np.concatenate([p[i] for p in parts]) if parts else [], t) for i, t in enumerate(types)]
    return pa.StructArray.from_arrays(cols, names)


def quality(docs: DataFrame, text: str = "text", out: str = "quality") -> DataFrame:
    """The documents with a struct column of the measures and the verdicts
    ``base_failed`` and ``kept``."""
    ship(docs.sparkSession)
    (m,) = fresh(docs, "measures")
    base_failed = (F.col(f"{m}.n_words") < MIN_WORDS) | (
        100 * F.col(f"{m}.n_repeat_words") > 50 * F.col(f"{m}.n_words"))
    kept = ~base_failed & (F.col(f"{m}.cover_lines") <= MAX_LINE_COVERAGE)
    for n, most in MAX_COVERAGE.items():
        kept = kept & (F.col(f"{m}.cover_{n}") <= most)
    measured = docs.withColumn(m, F.arrow_udf(measure_column, TYPE)(F.col(text)))
    fields = [F.col(f"{m}.{f}").alias(f) for f in FIELDS[0] + FIELDS[1]]
    return measured.select(*columns(docs, out), F.struct(
        *fields, base_failed.alias("base_failed"), kept.alias("kept")).alias(out))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs, out="q").select("doc_id", "q.*")
