"""Language ID by interpolated Kneser-Ney character models.

Letters become 64 symbols (lower case; a to z, hashed places for other letters, one for any run of
other characters), so four characters are a 24-bit number: the hash of the 4-gram. Every language
has a 4-gram model with absolute discounting; lower orders count distinct contexts (Kneser-Ney)
and are interpolated down to a uniform floor. The 4-grams of all languages are one sorted
array of hashes with a column of log-probabilities per language; a directory by the first three characters finds
a 4-gram's place in it. The language with the least cross-entropy per character wins.

Counts cover all learning documents (``crc32(doc_id) % 5`` of 2, 3 or 4, lang not null) and are summed by
Spark per language and 4-gram, so a hot language sends one row per 4-gram and task. Remainder 1 is
for calibration, on a bounded sample (``CALIBRATION_ROWS``): a logistic curve over the lead of the
best language and the text's length gives ``score``; ``rejected`` marks a score under ``REJECT_BELOW`` or a
cross-entropy above nearly all (``CEILING``) of the calibration texts of that language. Remainder 0 is
held out. A model is at most 2**24 entries a language, whatever the input.

Cases: a null text or one without a letter is ``und`` with score 0; equal cross-entropies go to the
first language by name; rows that repeat count each; a null doc_id is neither learned from nor held out; with no
language to learn every text is ``und``; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.llm.shared import columns, fresh, ship, table
from tillcast.llm.textbuf import IS_LEAD, Chunk, chunks

CONTEXTS = 1 << 18
CALIBRATION_ROWS = 3000
REJECT_BELOW = 0.5
CEILING = 0.999
#: Least and largest discount, where counts of counts are too few to tell.
DISCOUNT = (0.1, 0.95)


@lru_cache
def symbol_table() -> np.ndarray:
    """Symbol of every code point: 0 for what is no letter, 1 to 26, hashed 27 to 63."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x32400):
        if chr(c).isalpha():
            low = ord(chr(c).lower()[0])
            out[c] = low - 96 if 97 <= low <= 122 else 27 + (low * 0x9E3779B1 >> 13) % 37
    return out


def four_grams(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """24-bit 4-gram ending at each symbol, its text number, and letters per text."""
    points = np.frombuffer(chunk.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.concatenate(([0], np.cumsum(IS_LEAD[chunk.data])))[chunk.bounds]
    symbol = symbol_table()[points]
    doc = np.repeat(np.arange(chunk.n), np.diff(at))
    keep = symbol != 0
    letters = np.bincount(doc[keep], minlength=chunk.n)
    if len(symbol):
        keep[1:] |= (symbol[:-1] != 0) & (doc[1:] == doc[:-1])
    symbol, doc = symbol[keep].astype(np.uint32), doc[keep]
    place = np.arange(len(symbol)) + 3 * (doc + 1)  # three boundary symbols before each text
    line = np.zeros(len(symbol) + 3 * chunk.n, np.uint32)
    line[place] = symbol
    return line[place - 3] << 18 | line[place - 2] << 12 | line[place - 1] << 6 | symbol, doc, letters


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, gram, n): the 4-grams of each language in the batch."""
    for batch in batches:
        lang = pc.dictionary_encode(batch.column(0))
        which = lang.indices.to_numpy()
        grams, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for chunk in chunks(batch.column(1)):
            gram, doc, _ = four_grams(chunk)
            key = which[chunk.first + doc].astype(np.uint64) << np.uint64(24) | gram
            key, n = np.unique(key, return_counts=True)
            grams.append(key)
            counts.append(n)
        key, inverse = np.unique(np.concatenate(grams), return_inverse=True)
        n = np.bincount(inverse, np.concatenate(counts), minlength=len(key)).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [lang.dictionary.take(pa.array((key >> np.uint64(24)).astype(np.int64))),
             pa.array((key & np.uint64((1 << 24) - 1)).astype(np.int32)), pa.array(n)], ["lang", "gram", "n"])


def discount(counts: np.ndarray) -> float:
    one, two = int((counts == 1).sum()), int((counts == 2).sum())
    return float(np.clip(one / (one + 2 * two) if one else 0, *DISCOUNT))


def interpolated(counts: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Probabilities of the last symbol per context row, backed by the order below."""
    d = discount(counts)
    total = counts.sum(1, keepdims=True)
    weight = np.where(total > 0, d * (counts > 0).sum(1, keepdims=True) / np.maximum(total, 1), 1.0)
    return np.maximum(counts - d, 0) / np.maximum(total, 1) + weight * below


def train(rows: pa.Table) -> pa.Table:
    """Counts of one language -> its sorted 4-grams with log-probabilities, the log-weights of unseen
    continuations per context, and the log-probabilities of the order below."""
    rows = rows.sort_by("gram")
    gram, n = rows.column("gram").to_numpy().astype(np.int64), rows.column("n").to_numpy()
    seen3 = np.bincount(gram & (CONTEXTS - 1), minlength=CONTEXTS)  # distinct first characters
    seen2 = (seen3 > 0).reshape(64, 4096).sum(0)
    seen1 = (seen2 > 0).reshape(64, 64).sum(0)
    p1 = (seen1 + 0.1) / (seen1.sum() + 6.4)
    p2 = interpolated(seen2.reshape(64, 64), p1[None, :])
    p3 = interpolated(seen3.reshape(64, 64, 64).reshape(4096, 64),
                      np.broadcast_to(p2, (64, 64, 64)).reshape(4096, 64)).reshape(-1)
    d = discount(n)
    context = gram >> 6
    total = np.bincount(context, n, minlength=CONTEXTS)
    weight = np.where(total > 0, d * np.bincount(context, minlength=CONTEXTS) / np.maximum(total, 1), 1.0)
    p4 = np.maximum(n - d, 0) / total[context] + weight[context] * p3[gram & (CONTEXTS - 1)]
    raw = [gram.astype(np.uint32)] + [np.log(x).astype(np.float32) for x in (p4, weight, p3)]
    return pa.table([rows.column("lang").slice(0, 1), *([x.tobytes()] for x in raw)],
                    names=["lang", "gram", "p4", "weight", "p3"])


class Model:
    """All languages side by side."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: r["lang"])
        read = lambda r, k, t=np.float32: np.frombuffer(r[k], t)
        self.langs = [r["lang"] for r in rows]
        grams = [read(r, "gram", np.uint32) for r in rows]
        self.gram = np.unique(np.concatenate(grams))
        self.weight = np.stack([read(r, "weight") for r in rows], 1)
        self.p3 = np.stack([read(r, "p3") for r in rows], 1)
        self.p4 = self.weight[self.gram >> 6] + self.p3[self.gram & (CONTEXTS - 1)]
        for k, r in enumerate(rows):
            self.p4[np.searchsorted(self.gram, grams[k]), k] = read(r, "p4")
        context = self.gram >> 6
        self.first = np.searchsorted(context, np.arange(CONTEXTS)).astype(np.int32)
        self.members = np.zeros(CONTEXTS, np.uint64)  # a bit for each last symbol that is in the array
        np.bitwise_or.at(self.members, context, np.uint64(1) << (self.gram & np.uint32(63)).astype(np.uint64))

    def cross_entropy(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Nats per symbol of every text under every language, and letters per text."""
        gram, doc, letters = four_grams(chunk)
        context, last = gram >> 6, (gram & np.uint32(63)).astype(np.uint64)
        members = self.members[context]
        known = (members >> last & np.uint64(1)).astype(bool)
        place = self.first[context] + np.bitwise_count(members & ((np.uint64(1) << last) - np.uint64(1)))
        n = np.bincount(doc, minlength=chunk.n)
        out = np.zeros((chunk.n, len(self.langs)))
        new = ~known
        for k in range(len(self.langs)):
            value = np.empty(len(gram), np.float32)
            value[known] = self.p4[place[known], k]
            value[new] = self.weight[context[new], k] + self.p3[gram[new] & np.uint32(CONTEXTS - 1), k]
            out[:, k] = -np.bincount(doc, value, minlength=chunk.n) / np.maximum(n, 1)
        return out, letters


def best_column(model):
    def run(text: pa.Array) -> pa.Array:
        m = model.value
        parts = []
        for chunk in chunks(text):
            h, letters = m.cross_entropy(chunk)
            order = np.sort(h, axis=1)
            lead = order[:, 1] - order[:, 0] if h.shape[1] > 1 else np.full(chunk.n, 1.0)
            parts.append((np.where(letters > 0, h.argmin(1), -1), order[:, 0], lead, letters))
        cols = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in range(4)]
        return pa.StructArray.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.float64(), pa.float64(), pa.int64()))],
            ["best", "entropy", "lead", "letters"])
    return run


BEST = "struct<best:int,entropy:double,lead:double,letters:bigint>"


def calibrate(lead: np.ndarray, letters: np.ndarray, right: np.ndarray) -> tuple[float, float, float]:
    """A logistic curve of being right over lead * sqrt(letters) and log(letters), by Newton steps with
    a weak prior towards (0, 1, 0)."""
    x = np.column_stack([np.ones(len(lead)), lead * np.sqrt(letters), np.log1p(letters)])
    prior = np.array([0.0, 1.0, 0.0])

    def loss(b: np.ndarray) -> float:
        return float(np.logaddexp(0, np.where(right > 0, -1, 1) * (x @ b)).sum() + 0.25 * ((b - prior) ** 2).sum())

    b = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (right - p) - 0.5 * (b - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(3), g)
        size = 1.0
        while size > 1e-6 and loss(b + size * step) > loss(b):
            size /= 2
        b = b + size * step
    return tuple(float(v) for v in b)


def remainder(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
             out: str = "language") -> DataFrame:
    """The documents with a struct column: held_out, lang_pred, score, rejected, entropy."""
    spark = docs.sparkSession
    ship(spark)
    fold = remainder(doc_id)
    labelled = docs.where(F.col(lang).isNotNull())
    counts = (labelled.where(fold >= 2).select(lang, text)
              .mapInArrow(count_batches, "lang string, gram int, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    rows = counts.groupBy("lang").applyInArrow(
        train, "lang string, gram binary, p4 binary, weight binary, p3 binary").collect()  # one row a language
    held = F.coalesce(fold == 0, F.lit(False))
    if not rows:
        return docs.withColumn(out, F.struct(held.alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"),
                                             F.lit(True).alias("rejected"), F.lit(None).cast("double").alias("entropy")))
    model = Model(rows)
    best = F.arrow_udf(best_column(spark.sparkContext.broadcast(model)), BEST)(F.col(text))
    names = F.array(*(F.lit(x) for x in model.langs))

    spare = labelled.where(fold == 1)
    slots = max(1, round(1_000_000 * min(1.0, CALIBRATION_ROWS / max(1, spare.count()))))
    (b,) = fresh(docs, "best")
    sample = (spare.where(F.pmod(F.xxhash64(doc_id), F.lit(1_000_000)) < slots)
              .select(lang, best.alias(b)).where(f"{b}.best >= 0").select(lang, f"{b}.*").collect())
    true = np.array([r[lang] == model.langs[r["best"]] for r in sample], float)
    a0, a1, a2 = calibrate(*(np.array([r[k] for r in sample], float) for k in ("lead", "letters")), true)
    ceiling = []
    for k in range(len(model.langs)):
        own = [r["entropy"] for r in sample if r["best"] == k]
        ceiling.append(float(np.quantile(own, CEILING)) * 1.05 if own else float("inf"))

    lead, letters = F.col(f"{b}.lead"), F.col(f"{b}.letters").cast("double")
    logit = F.lit(a0) + F.lit(a1) * lead * F.sqrt(letters) + F.lit(a2) * F.log1p(letters)
    found = F.col(f"{b}.best") >= 0
    score = F.when(found, 1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(30.0)), F.lit(-30.0))))).otherwise(0.0)
    limit = F.get(F.array(*(F.lit(x) for x in ceiling)), F.col(f"{b}.best"))
    return docs.withColumn(b, best).select(*columns(docs, out), F.struct(
        held.alias("held_out"), F.when(found, F.get(names, F.col(f"{b}.best"))).otherwise("und").alias("lang_pred"),
        score.alias("score"), (~found | (score < REJECT_BELOW) | (F.col(f"{b}.entropy") > limit)).alias("rejected"),
        F.when(found, F.col(f"{b}.entropy")).alias("entropy")).alias(out))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, out="l").select("doc_id", "l.*")
