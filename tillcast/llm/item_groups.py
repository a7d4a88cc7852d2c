"""The items of a benchmark table in groups of bounded size, and the terms of whole texts.

A group is what a job broadcasts, so the bytes of its texts are checked: groups are dealt by a hash
of the item id and doubled until none holds more than ``limit`` bytes (or there are as many groups as
items; an item that is longer by itself is a group's only large one).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.llm.textbuf import LOWER, Chunk, chunks

#: Bytes of item texts that one job broadcasts at most.
GROUP_BYTES = 4 << 20

#: Letters A-Z, a-z, digits and every byte of a code point beyond ASCII.
IS_TERM = np.zeros(256, bool)
IS_TERM[48:58] = IS_TERM[65:91] = IS_TERM[97:123] = IS_TERM[128:] = True


def groups(items: DataFrame, item_id: str, text: str, limit: int = GROUP_BYTES) -> Iterator[pa.Table]:
    """Tables (id, text) of distinct rows without null texts; together they are all items."""
    rows = items.where(F.col(text).isNotNull()).select(F.col(item_id).alias("id"), F.col(text).alias("text")).distinct()
    size = F.octet_length("text")
    n, total, longest = rows.agg(F.count("*"), F.sum(size), F.max(size)).first()
    if not n:
        return
    count = -(-total // limit) or 1
    while True:
        dealt = rows.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(count)))
        most = dealt.groupBy("g").agg(F.sum(size).alias("b")).agg(F.max("b")).first()[0]
        if most <= max(limit, longest) or count >= n:
            break
        count *= 2
    for g in range(count):
        found = dealt.where(F.col("g") == g).select("id", "text").toArrow()  # bounded: limit
        if found.num_rows:
            yield found.sort_by([("id", "ascending"), ("text", "ascending")])


def terms(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every term, A-Z lower-cased."""
    starts, ends = chunk.runs(IS_TERM)
    return chunk.hasher(LOWER)(starts, ends), np.searchsorted(chunk.bounds, starts, side="right") - 1


def item_terms(items: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct ids of a group, and for every term of its texts, in order: the text's number
    in the table and the term's hash."""
    at, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for chunk in chunks(items.column("text")):
        found, doc = terms(chunk)
        at.append(doc + chunk.first)
        hashes.append(found)
    return items.column("id").combine_chunks(), np.concatenate(at), np.concatenate(hashes)


def number_of(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The place of each value in the sorted array known, or -1."""
    if not len(known):
        return np.full(len(values), -1, np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)
