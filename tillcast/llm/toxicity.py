"""Toxicity: cumulative-link (ordinal) regression over sparse text features.

A grade y in 0..K-1 has P(y >= k) = sigmoid(w.x - t_k): one weight vector for all grades and
rising thresholds t_1 < t_2 < ... The features of a text are its distinct words, hashed to
``DIM`` places, with value log(1 + count) times the place's log-odds between graded and
clean training texts; places seen in fewer than ``MIN_TEXTS`` training texts, or with
log-odds near 0, are left out. The likelihood is maximised by full gradient steps.

The model is fitted in one task on at most ``SAMPLE_ROWS`` labelled documents, chosen by a
hash of their id (the documented bound of the sample); every document is then scored whole.
The labels table has only a flag. ``weak_grades`` makes grades of it: 0 for clean texts; the
toxic ones are ranked by their summed log-odds and cut into equal thirds, grades 1 to 3.

Cases: a null or empty text has no features and gets the model's intercept; labels that are
null, or of unknown documents, are left out; a document labelled more than once counts with
its highest flag; rows that repeat a doc_id count once in training; without labels of both
kinds every severity is 0 and nothing is toxic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.llm.shared import columns, fresh, ship, table
from tillcast.llm.textbuf import LOWER, Chunk, chunks

DIM = 1 << 18
SAMPLE_ROWS = 12_000
MIN_TEXTS = 4
LEVELS = 3
STEPS = 150
RATE = 0.1
L2 = 2e-4
#: A document is toxic when P(grade >= 1) reaches this.
REJECT = 0.4

#: Characters of feature words: ASCII letters and digits, and all bytes of other characters.
_LETTER = np.zeros(256, bool)
_LETTER[128:] = True
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = True


def places(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hashed place of every word of a chunk."""
    starts, ends = chunk.runs(_LETTER)
    doc = np.repeat(np.arange(chunk.n), np.diff(np.searchsorted(starts, chunk.bounds)))
    return doc, (chunk.hasher(LOWER)(starts, ends) % np.uint64(DIM)).astype(np.int64)


def counted(doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, place) pairs, ordered, with their counts."""
    pair, n = np.unique(doc * DIM + place, return_counts=True)
    return pair // DIM, pair % DIM, n


def features_column(text: pa.Array) -> pa.Array:
    """Per text the distinct places (uint32) and counts (float32) as two byte strings."""
    out = []
    for chunk in chunks(text):
        doc, place, n = counted(*places(chunk))
        at = np.searchsorted(doc, np.arange(chunk.n + 1))
        out += [(place[a:b].astype(np.uint32).tobytes(), n[a:b].astype(np.float32).tobytes())
                for a, b in zip(at[:-1], at[1:])]
    return pa.StructArray.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)],
                                      ["place", "n"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def log_odds(row: np.ndarray, place: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Per place the smoothed log-odds of occurring in toxic against clean texts, 0 for weak ones."""
    with_toxic = np.bincount(place[toxic[row]], minlength=DIM).astype(float)
    with_clean = np.bincount(place[~toxic[row]], minlength=DIM).astype(float)
    p = (with_toxic + 0.5) / (toxic.sum() + 1.0)
    q = (with_clean + 0.5) / ((~toxic).sum() + 1.0)
    r = np.log(p / (1 - np.minimum(p, 0.999))) - np.log(q / (1 - np.minimum(q, 0.999)))
    r[(with_toxic + with_clean < MIN_TEXTS) | (np.abs(r) < 1.0)] = 0.0
    return r


def weak_grades(row: np.ndarray, value: np.ndarray, toxic: np.ndarray, levels: int = LEVELS) -> np.ndarray:
    """Grade 0 for clean texts, 1..levels for toxic ones by equal parts of their strength."""
    strength = np.bincount(row, np.maximum(value, 0), minlength=len(toxic))
    grade = np.zeros(len(toxic), np.int64)
    at = np.flatnonzero(toxic)
    order = at[np.argsort(strength[at], kind="stable")]
    grade[order] = 1 + np.arange(len(order)) * levels // max(1, len(order))
    return grade


def fit_ordinal(row: np.ndarray, col: np.ndarray, value: np.ndarray, grade: np.ndarray,
                n_cols: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative-link model, by Adam on the mean log-likelihood
    with an L2 term. Thresholds are a first value and positive steps, so they stay in order."""
    n, k = len(grade), int(grade.max())
    share = np.array([np.clip((grade >= j).mean(), 1e-4, 1 - 1e-4) for j in range(1, k + 1)])
    cut = -np.log(share / (1 - share))
    free = np.concatenate([np.zeros(n_cols), [cut[0]], np.log(np.maximum(np.diff(cut), 1e-2))])
    m, v = np.zeros_like(free), np.zeros_like(free)
    at_or_above, above = grade >= 1, grade < k
    for step in range(1, STEPS + 1):
        w, b = free[:n_cols], free[n_cols:]
        t = b[0] + np.concatenate(([0.0], np.cumsum(np.exp(b[1:]))))
        eta = np.bincount(row, w[col] * value, minlength=n)
        low = np.where(at_or_above, _sigmoid(eta - t[np.maximum(grade, 1) - 1]), 1.0)
        high = np.where(above, _sigmoid(eta - t[np.minimum(grade, k - 1)]), 0.0)
        p = np.maximum(low - high, 1e-12)
        d_low, d_high = low * (1 - low) / p, high * (1 - high) / p
        d_eta = d_low - d_high
        d_t = np.zeros(k)
        np.add.at(d_t, np.maximum(grade, 1) - 1, -d_low * at_or_above)
        np.add.at(d_t, np.minimum(grade, k - 1), d_high * above)
        later = np.cumsum(d_t[::-1])[::-1]
        g = np.concatenate([np.bincount(col, d_eta[row] * value, minlength=n_cols) / n - L2 * w,
                            [later[0] / n], later[1:] * np.exp(b[1:]) / n])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        free += RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
    b = free[n_cols:]
    return free[:n_cols], b[0] + np.concatenate(([0.0], np.cumsum(np.exp(b[1:]))))


def fit_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One task: the model of the sample's rows (flag, place, n) as one row of byte strings."""
    rows = pd.concat(list(batches) or [pd.DataFrame({"flag": [], "place": [], "n": []})])
    rows = rows.sort_values(["flag", "doc_id"], kind="stable") if len(rows) else rows
    toxic = rows["flag"].to_numpy() > 0
    if not len(rows) or toxic.all() or not toxic.any():
        return
    place = np.frombuffer(b"".join(rows["place"]), np.uint32).astype(np.int64)
    tf = np.log1p(np.frombuffer(b"".join(rows["n"]), np.float32).astype(float))
    row = np.repeat(np.arange(len(rows)), [len(x) // 4 for x in rows["place"]])
    r = log_odds(row, place, toxic)
    strong = r[place] != 0
    row, place, value = row[strong], place[strong], (r[place] * tf)[strong]
    used, col = np.unique(place, return_inverse=True)
    grade = weak_grades(row, value, toxic)
    w, t = fit_ordinal(row, col, value, grade, len(used))
    yield pd.DataFrame({"place": [used.astype(np.int64).tobytes()], "weight": [(w * r[used]).tobytes()],
                        "threshold": [t.tobytes()]})


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Dense weights (DIM of them) and thresholds, from labels (doc_id, toxic) of docs."""
    ship(docs.sparkSession)
    flags = (labels.where("doc_id is not null and toxic is not null").groupBy("doc_id")
             .agg(F.max("toxic").alias("flag")))
    chosen = flags.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)  # bounded, so broadcast
    features = F.arrow_udf(features_column, "struct<place:binary,n:binary>")
    sample = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
              .select("doc_id", "flag", features(F.col("text")).alias("f")).select("doc_id", "flag", "f.*")
              .dropDuplicates(["doc_id"]))
    found = (sample.repartition(1).mapInPandas(fit_rows, "place binary, weight binary, threshold binary")
             .collect())  # one row: at most DIM weights
    weights = np.zeros(DIM, np.float64)
    if not found:
        return weights, np.array([np.inf])
    weights[np.frombuffer(found[0]["place"], np.int64)] = np.frombuffer(found[0]["weight"], np.float64)
    return weights, np.frombuffer(found[0]["threshold"], np.float64).copy()


def score_chunk(chunk: Chunk, weights: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected severity, most likely grade and P(grade >= 1) of the texts of a chunk."""
    doc, place = places(chunk)
    heavy = weights[place] != 0
    doc, place, n = counted(doc[heavy], place[heavy])
    eta = np.bincount(doc, weights[place] * np.log1p(n), minlength=chunk.n)
    above = _sigmoid(np.where(np.isinf(t), -35.0, eta[:, None] - np.where(np.isinf(t), 0, t)))
    above[:, np.isinf(t)] = 0.0
    each = np.diff(np.concatenate([np.zeros((chunk.n, 1)), 1 - above, np.ones((chunk.n, 1))], 1), axis=1)
    return above.sum(1), each.argmax(1), above[:, 0]


def scorer(model):
    def score_column(text: pa.Array) -> pa.Array:
        weights, t = model.value
        parts = [score_chunk(c, weights, t) for c in chunks(text)]
        cols = [pa.array(np.concatenate([p[k] for p in parts]) if parts else [], kind)
                for k, kind in enumerate((pa.float64(), pa.int32(), pa.float64()))]
        return pa.StructArray.from_arrays(cols, ["severity", "grade", "p_toxic"])
    return score_column


def score(docs: DataFrame, labels: DataFrame, out: str = "toxicity") -> DataFrame:
    """The documents with a struct column: severity (expected grade), grade, p_toxic, toxic."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    (s,) = fresh(docs, "scores")
    scored = docs.withColumn(s, F.arrow_udf(
        scorer(model), "struct<severity:double,grade:int,p_toxic:double>")(F.col("text")))
    return scored.select(*columns(docs, out), F.struct(
        f"{s}.severity", f"{s}.grade", f"{s}.p_toxic",
        (F.col(f"{s}.p_toxic") >= REJECT).alias("toxic")).alias(out))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, table(spark, sf_dir, "labels"), "t").select("doc_id", "t.*")
