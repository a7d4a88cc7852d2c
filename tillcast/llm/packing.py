"""Packing token sequences by first-fit decreasing in randomised groups.

Texts become token ids, each closed by an end id. A document of more than ``capacity`` ids
is cut into whole sequences and one rest. Rests are dealt to randomised groups of about
``GROUP_DOCS``; inside a group first-fit decreasing places the longest first, each in
the first bin with room. The bins are the leaves of a tournament tree whose inner nodes
hold the most room below, so the first fitting bin is found by one walk from the root.
A group leaves about one partly filled sequence at its end, so padding is some hundredths
of a percent to some tenths; no sequence is cut short or dropped.

Tokenization: the tokenizer drops white space and never joins characters across it, so a
text's ids are those of its white-space separated strings in order. Each distinct string
of a chunk is encoded once; a worker remembers up to ``CACHE`` of them and then starts anew.

Pieces are dealt by a hash of document, start and checksum, so a document's pieces and rows of a
hot source spread over all groups; only identical rows (same id and text) share a group.

Cases: a null or empty text is the end id alone; rows that repeat a doc_id are packed as
documents of their own; a null doc_id stays null; ties in length are ordered by doc_id, start
and checksum; a very long text is tokenized and cut whole; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.llm.shared import ship, table
from tillcast.llm.textbuf import Chunk, chunks

CAPACITY = 4096
END_ID = 2
GROUP_DOCS = 2048
CACHE = 400_000
PIECES = "array<struct<start:bigint,length:bigint,ids_crc32:bigint,doc_tokens:bigint>>"

#: Strings of these characters alone are the same before and after NFC, have plain lower-case
#: forms, and their letters are the Latin ranges below; others go through the whole tokenizer.
PLAIN = re.compile("[!-~\u00c0-\u012f\u0131-\u017e]*")
#: The pre-tokenizer's pattern (a fixed value of the tokenizer file), for plain lower-case strings.
LETTER = "a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017e"
PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[0-9]|[^{LETTER}0-9]+")

_encoders: dict[str, Encoder] = {}


def gather(values: np.ndarray, at: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges values[at[s]:at[s + 1]] one after the other, and where each ends."""
    size = at[slots + 1] - at[slots]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(at[slots] - (ends - size), size)], ends


class Encoder:
    """Token ids of texts, with a bounded memory of the strings that came before.

    A string is known by its 64-bit hash; ``keys`` are sorted, ``slot`` says where a key's
    ids lie in ``ids`` (from ``at[slot]`` to ``at[slot + 1]``).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        spec["normalizer"] = None
        spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [
            {"type": "WhitespaceSplit"},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        self.split = Tokenizer.from_str(json.dumps(spec))  # the same vocabulary, for strings cut before
        self.closes = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)  # ends a part
        self.closes[[i for t, i in spec["model"]["vocab"].items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.at, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)
        self.part_slot: dict[str, int] = {}
        self.part_at, self.part_ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def learn_parts(self, parts: list[str]) -> None:
        """Adds the ids of new plain parts, many of them in one call of the tokenizer."""
        for lo in range(0, len(parts), 20_000):
            some = parts[lo:lo + 20_000]
            (e,) = self.split.encode_batch_fast([" ".join(some)], add_special_tokens=False)
            ids = np.array(e.ids, np.uint32)
            self.part_slot.update(zip(some, range(len(self.part_slot), len(self.part_slot) + len(some))))
            self.part_at = np.concatenate(
                [self.part_at, self.part_at[-1] + np.flatnonzero(self.closes[ids]) + 1])
            self.part_ids = np.concatenate([self.part_ids, ids])

    def learn(self, keys: np.ndarray, strings: list[bytes]) -> None:
        """Adds the ids of new strings."""
        plain = [bool(PLAIN.fullmatch(s)) and "<|" not in s
                 for s in b"\n".join(strings).decode("utf-8").split("\n")]
        low = [s for s, p in zip(b"\n".join(strings).decode("utf-8").lower().split("\n"), plain) if p]
        odd = [s.decode("utf-8") for s, p in zip(strings, plain) if not p]
        keys = np.concatenate([keys[plain], keys[~np.array(plain)]])
        parts = [PARTS.findall(s) for s in low]
        flat = list(chain.from_iterable(parts))
        self.learn_parts([x for x in dict.fromkeys(flat) if x not in self.part_slot])
        slot = np.fromiter(map(self.part_slot.__getitem__, flat), np.int64, len(flat))
        ids, ends = gather(self.part_ids, self.part_at, slot)
        ends = np.concatenate(([0], ends))[np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))]
        rest = [e.ids for e in self.whole.encode_batch(odd, add_special_tokens=False)]
        ends = np.concatenate([ends, len(ids) + np.cumsum([len(x) for x in rest], dtype=np.int64)])
        slots = np.arange(len(keys)) + len(self.at) - 1
        self.at = np.concatenate([self.at, self.at[-1] + ends])
        self.ids = np.concatenate([self.ids, ids, np.array(list(chain.from_iterable(rest)), np.uint32)])
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys, self.slot = keys[order], np.concatenate([self.slot, slots])[order]

    def encode(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a chunk's texts, one after the other, and where each text's begin (n + 1)."""
        starts, ends = chunk.words
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(chunk.n + 1, np.int64)
        keys, first, which = np.unique(chunk.hasher()(starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > CACHE:
            self.forget()
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == keys[inside]
        if not known.all():
            unknown = first[~known]
            self.learn(keys[~known], [chunk.data[s:e].tobytes() for s, e in zip(
                starts[unknown].tolist(), ends[unknown].tolist())])
            place = np.searchsorted(self.keys, keys)
        ids, stops = gather(self.ids, self.at, self.slot[place][which])
        return ids, np.concatenate(([0], stops))[chunk.word_bounds]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(ids: np.ndarray, capacity: int) -> list[tuple[int, int, int, int]]:
    """(start, length, checksum, ids in all) of the pieces of at most capacity ids."""
    n = len(ids)
    raw = ids.astype("<u4").tobytes()
    return [(a, min(capacity, n - a), zlib.crc32(raw[4 * a:4 * (a + capacity)]), n)
            for a in range(0, n, capacity)]


def pieces_column(path: str, capacity: int, end_id: int):
    def pieces(text: pa.Array) -> pa.Array:
        enc, size, rows = encoder(path), [0], []
        end = np.array([end_id], np.uint32)
        for chunk in chunks(text):
            ids, at = enc.encode(chunk)
            for i in range(chunk.n):
                rows += cut(np.concatenate([ids[at[i]:at[i + 1]], end]), capacity)
                size.append(len(rows))
        values = np.array(rows, np.int64).reshape(-1, 4)
        return pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.StructArray.from_arrays(
            [pa.array(values[:, k]) for k in range(4)], ["start", "length", "ids_crc32", "doc_tokens"]))
    return pieces


class Tournament:
    """First fit over bins of equal capacity: a tree of the most room below each node."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, length: int) -> int:
        """The first bin with so much room, which then has less."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < length:
                node += 1
        room[node] -= length
        bin_, node = node - self.leaves, node // 2
        while node:
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
            node //= 2
        return bin_


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[int]:
    """Bin of every length; lengths must not rise."""
    tree = Tournament(len(lengths), capacity)
    return [tree.place(n) for n in lengths]


def packed_group(capacity: int):
    def pack_group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"],
                                ascending=[False, True, True, True], kind="stable")
        lengths = rows["length"].tolist()
        bins = first_fit_decreasing(lengths, capacity)
        used, offsets = [0] * len(lengths), []
        for b, n in zip(bins, lengths):
            offsets.append(used[b])
            used[b] += n
        # A nullable doc_id comes as floats; pandas' Int64 keeps its digits and its nulls.
        return rows.assign(sequence_id=rows["group"] * (1 << 32) + np.array(bins, np.int64),
                           offset=np.array(offsets, np.int64)).drop(columns="group")
    return pack_group


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
         capacity: int = CAPACITY, end_id: int = END_ID, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Pieces of all documents with their sequence and place: doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset. ``tokenizer`` is the path of a tokenizer file
    that every executor can read."""
    ship(docs.sparkSession)
    groups = max(1, -(-docs.count() // group_docs))
    found = F.arrow_udf(pieces_column(tokenizer, capacity, end_id), PIECES)
    pieces = (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.explode(found(F.col(text))).alias("p"))
              .select("doc_id", "p.*")
              .withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups))))
    schema = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
              "sequence_id long, offset long")
    return pieces.groupBy("group").applyInPandas(packed_group(capacity), schema)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
