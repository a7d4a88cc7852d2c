"""Benchmark decontamination by an FM-index per shard of training texts.

A window are 10 consecutive words of an item (all of them, if it has fewer). Words become numbers of the
items' vocabulary; a word that no item has ends a run, and a run shorter than the shortest
window cannot hold one. The runs of a shard (about ``SHARD`` numbers of one Arrow batch of texts) get an FM-index;
all distinct windows are searched backwards at once through the ranks of its wavelet matrix, their
occurrences are located from sampled suffix positions, and overlapping or touching ones are merged
to the spans that ``remove`` cuts out.

Items come in groups of at most ``item_groups.GROUP_BYTES`` bytes, which bounds the broadcast; with more groups
than one the occurrences of each are written and merged at the end. Words are told apart by 64-bit hashes.

Cases: a null or empty text has no words and no hit; texts are searched whole; repeated rows get equal results
each; an item without words (or null) has no window; rows that repeat an item_id are one item; a null item_id
counts and is removed, but has no name in the list; without items nothing is hit; an empty table gives
no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.llm.fm_index import Index
from tillcast.llm.item_groups import IS_TERM, groups, item_terms, number_of
from tillcast.llm.shared import columns, fresh, ship, table, written
from tillcast.llm.textbuf import LOWER, chunks

WINDOW = 10
#: Symbols of a shard, beyond which the next chunk of texts begins a new one.
SHARD = 1 << 20
SPANS = "array<struct<start:bigint,end:bigint,byte_start:bigint,byte_end:bigint>>"
TYPE = f"struct<n_words:bigint,spans:{SPANS},items:array<string>>"
FIELDS = ("start", "end", "byte_start", "byte_end")


class Patterns:
    """The distinct windows of a group of items: vocabulary, symbols, lengths, and items of each."""

    def __init__(self, item: np.ndarray, row: np.ndarray, hashes: np.ndarray):
        self.vocabulary, word = np.unique(hashes, return_inverse=True)
        word = word + 1
        size = np.bincount(row, minlength=len(item))
        first = np.cumsum(size) - size
        starts = np.concatenate([np.arange(f, f + max(n - WINDOW + 1, 1)) for f, n in zip(first, size) if n] or [np.zeros(0, np.int64)])
        ends = np.minimum(starts + WINDOW, (first + size)[row[starts]])
        rows = np.zeros((len(starts), WINDOW), np.int32)
        for k in range(WINDOW):
            inside = starts + k < ends
            rows[inside, k] = word[starts[inside] + k]
        self.symbols, number = np.unique(rows, axis=0, return_inverse=True)
        self.length = np.count_nonzero(self.symbols, axis=1)
        pair = np.unique(number.reshape(-1) * max(len(item), 1) + item[row[starts]])
        self.item = pair % max(len(item), 1)
        self.at = np.searchsorted(pair // max(len(item), 1), np.arange(len(self.symbols) + 1))
        self.least = int(self.length.min(initial=WINDOW))


def runs(number: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all runs of known words of one text, at least so long, each closed by a 0, and the
    word's place behind every symbol (-1 at a 0)."""
    known = number >= 0
    edge = np.concatenate(([True], (doc[1:] != doc[:-1]) | ~known[1:] | ~known[:-1])) if len(doc) else np.zeros(0, bool)
    start = np.flatnonzero(edge)
    size = np.diff(np.append(start, len(number)))
    use = known[start] & (size >= least)
    start, size = start[use], size[use]
    ends = np.cumsum(size + 1)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size - 1), size + 1)
    at[ends - 1] = -1
    return np.where(at >= 0, number[at] + 1, 0) if len(at) else at, at


def occurrences(text: np.ndarray, at: np.ndarray, patterns: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """First word and window of all occurrences in the runs of a shard."""
    if not len(text) or not len(patterns.length):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    index = Index(text)
    low, high = index.count(patterns.symbols, patterns.length)
    many = np.maximum(high - low, 0)
    window = np.repeat(np.arange(len(many)), many)
    rows = np.arange(int(many.sum())) + np.repeat(low - (np.cumsum(many) - many), many)
    return at[index.locate(rows)], window


def joined(start: np.ndarray, end: np.ndarray, last: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which spans [start, end), in order of doc and start, begin one when those of a text that overlap
    or touch are one, and the largest last of each of these."""
    if not len(start):
        return np.zeros(0, np.int64), last
    shift = doc * (int(end.max()) + 2)  # keeps texts apart
    furthest = np.maximum.accumulate(end + shift)
    of = np.flatnonzero(np.concatenate(([True], start[1:] + shift[1:] > furthest[:-1])))
    return of, np.maximum.reduceat(last, of)


def _column(n_words: np.ndarray, doc: np.ndarray, spans: list[np.ndarray], item_doc: np.ndarray, items: pa.Array) -> pa.Array:
    """The result column: spans and items by text number, both in its order."""
    def lists(values: pa.Array, at: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(len(n_words) + 1)).astype(np.int32)), values)

    span = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in spans], list(FIELDS))
    return pa.StructArray.from_arrays([pa.array(n_words), lists(span, doc), lists(items, item_doc)], ["n_words", "spans", "items"])


def finder(known):
    """texts -> (n_words, spans, items): what the windows of a group of items cover in every text."""
    def find(text: pa.Array) -> pa.Array:
        names, patterns = known.value
        n_words = np.zeros(len(text), np.int64)
        none = np.zeros(0, np.int64)
        found, items, shard, size = [(none,) * 5], [np.zeros((0, 2), np.int64)], [], 0

        def search() -> None:
            base = np.cumsum([0] + [len(x[1]) for x in shard])
            symbols = np.concatenate([x[0][0] for x in shard])
            at = np.concatenate([np.where(x[0][1] >= 0, x[0][1] + b, -1) for x, b in zip(shard, base)])
            doc, place, first, last = (np.concatenate([x[k] for x in shard]) for k in range(1, 5))
            word, window = occurrences(symbols, at, patterns)
            order = np.argsort(word, kind="stable")
            word, window = word[order], window[order]
            end = word + patterns.length[window] - 1
            of, reach = joined(place[word], place[end] + 1, end, doc[word])
            start = word[of]
            found.append((doc[start], place[start], place[reach] + 1, first[start], last[reach]))
            many = patterns.at[window + 1] - patterns.at[window]
            item = patterns.item[np.arange(int(many.sum())) + np.repeat(patterns.at[window] - (np.cumsum(many) - many), many)]
            items.append(np.unique(np.stack((np.repeat(doc[word], many), item), 1), axis=0))
            shard.clear()

        for chunk in chunks(text):
            starts, ends = chunk.runs(IS_TERM)
            doc = np.searchsorted(chunk.bounds, starts, side="right") - 1
            size_of = np.bincount(doc, minlength=chunk.n)
            n_words[chunk.first:chunk.first + chunk.n] = size_of
            symbols, at = runs(number_of(chunk.hasher(LOWER)(starts, ends), patterns.vocabulary), doc, patterns.least)
            if not len(symbols):
                continue
            used = at[at >= 0]
            at[at >= 0] = np.arange(len(used))
            of, byte = doc[used], chunk.bounds[doc[used]]
            place = used - (np.cumsum(size_of) - size_of)[of]
            shard.append(((symbols, at), of + chunk.first, place, starts[used] - byte, ends[used] - byte))
            size += len(symbols)
            if size >= SHARD:
                search()
                size = 0
        if shard:
            search()
        doc, *spans = (np.concatenate(x) for x in zip(*found))
        pair = np.concatenate(items)
        return _column(n_words, doc, spans, pair[:, 0], names.take(pa.array(pair[:, 1])))
    return find


def both(a: pa.Array, b: pa.Array) -> pa.Array:
    """Two result columns of different items as one."""
    def flat(x: pa.Array, field: str) -> tuple[np.ndarray, pa.Array]:
        lists = x.field(field)
        return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten()

    parts = [flat(x, "spans") for x in (a, b)]
    doc = np.concatenate([d for d, _ in parts])
    start, end, first, last = (np.concatenate([s.field(f).to_numpy(zero_copy_only=False) for _, s in parts]) for f in FIELDS)
    order = np.lexsort((end, start, doc))
    doc, start, end, first, last = (x[order] for x in (doc, start, end, first, last))
    of, end = joined(start, end, end, doc)
    spans = [start[of], end, first[of], np.maximum.reduceat(last, of) if len(of) else last]
    names = [flat(x, "items") for x in (a, b)]
    owner = np.concatenate([d for d, _ in names])
    order = np.argsort(owner, kind="stable")
    items = pa.concat_arrays([v for _, v in names]).take(pa.array(order))
    return _column(a.field("n_words").to_numpy(zero_copy_only=False), doc[of], spans, owner[order], items)


def find(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
         out: str = "found", group_bytes: int | None = None) -> DataFrame:
    """The documents with a struct column: n_words, spans (first word, end, first byte, end) and the items
    (as strings) of which a window occurs. A column of docs that is named like out goes."""
    spark = docs.sparkSession
    ship(spark)
    kept = columns(docs, out)
    (part,) = fresh(docs, "part")
    result = None
    for group in groups(items, item_id, item_text, **({"limit": group_bytes} if group_bytes else {})):
        row_ids, row, hashes = item_terms(group)
        ids = row_ids.unique()
        of_row = row_ids.dictionary_encode("encode").indices.to_numpy()
        known = spark.sparkContext.broadcast((ids.cast(pa.string()), Patterns(of_row.astype(np.int64), row, hashes)))
        search = F.arrow_udf(finder(known), TYPE)(F.col(text))
        if result is None:
            result = docs.select(*kept, search.alias(out))
        else:
            result = written(result).withColumn(part, search).select(
                *kept, F.arrow_udf(both, TYPE)(F.col(out), F.col(part)).alias(out))
    if result is None:
        known = spark.sparkContext.broadcast((pa.array([], pa.string()), Patterns(*(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64)))))
        result = docs.select(*kept, F.arrow_udf(finder(known), TYPE)(F.col(text)).alias(out))
    return result


def cut(text: pa.Array, found: pa.Array) -> pa.Array:
    """The texts without their spans; a space stays for each."""
    spans, out = found.field("spans").to_pylist(), []
    for value, cuts in zip(text.to_pylist(), spans):
        if cuts and value is not None:
            raw, at, kept = value.encode(), 0, []
            for span in cuts:
                kept.append(raw[at:span["byte_start"]])
                at = span["byte_end"]
            value = b" ".join([*kept, raw[at:]]).decode()
        out.append(value)
    return pa.array(out, text.type)


def remove(docs: DataFrame, items: DataFrame, text: str = "text", **names) -> DataFrame:
    """The documents with every span cut out of the text; all other columns as they are."""
    (out,) = fresh(docs, "found")
    found = find(docs, items, text, out=out, **names)
    kind = docs.schema[text].dataType.simpleString()
    return found.withColumn(text, F.arrow_udf(cut, kind)(F.col(text), F.col(out))).select(*columns(docs))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("found.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "found.n_words", n_hit.alias("n_hit"), F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("found.items"), ","), 256).alias("items_sha256"),
        (F.size("found.spans") > 0).alias("contaminated"))


_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""
OP13_SQL = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, len(g) AS n, array_to_string(g, ' ') AS g FROM (
    SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1), lambda i: w[i:i + {WINDOW} - 1])) AS g
    FROM item WHERE len(w) > 0)),
found AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (
    SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM win))
  WHERE array_to_string(w[i:i + n - 1], ' ') IN (SELECT g FROM win)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
items AS (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found JOIN win USING (n, g)),
listed AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM items GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN listed USING (r)
"""
