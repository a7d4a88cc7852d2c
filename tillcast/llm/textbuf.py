"""Whole texts as byte arrays: words, hashes and per-document sums in numpy.

An Arrow string column is one byte buffer and an offset per row. The helpers cut a
column into chunks of at most ``CHUNK_BYTES`` (a longer text is a chunk of its own, so
a text is never cut) and work on a chunk at once; there is no Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20
U64 = np.uint64
SPACE_BYTES = (9, 10, 11, 12, 13, 32)

IS_WORD = np.ones(256, bool)
IS_WORD[list(SPACE_BYTES)] = False
IDENTITY = np.arange(256, dtype=np.uint8)
LOWER = IDENTITY.copy()
LOWER[65:91] += 32
#: True for the first byte of every code point.
IS_LEAD = (IDENTITY & 0xC0) != 0x80


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (shift, multiply, twice)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


_BASE = U64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xA0761D6478BD642F))
_powers = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n, modulo 2**64; grown on demand."""
    if len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, b in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, b, U64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


@dataclass
class Chunk:
    """Some whole texts: ``data`` are their bytes, ``bounds`` the n + 1 ends between them."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def n(self) -> int:
        return len(self.bounds) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i]:self.bounds[i + 1]].tobytes()

    def runs(self, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte starts and ends of the maximal runs of member bytes; no run spans two texts."""
        w = member[self.data]
        edge = np.zeros(len(w) + 1, bool)
        edge[self.bounds] = True
        before, after = np.zeros(len(w), bool), np.zeros(len(w), bool)
        before[1:], after[:-1] = w[:-1], w[1:]
        starts = np.flatnonzero(w & (~before | edge[:-1]))
        return starts, np.flatnonzero(w & (~after | edge[1:])) + 1

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """The words ``[^\\x20\\x09-\\x0D]+`` of all texts."""
        return self.runs(IS_WORD)

    @cached_property
    def word_bounds(self) -> np.ndarray:
        """Word number at which each text begins (n + 1 values)."""
        return np.searchsorted(self.words[0], self.bounds)

    @cached_property
    def word_doc(self) -> np.ndarray:
        """Text number of every word."""
        return np.repeat(np.arange(self.n), np.diff(self.word_bounds))

    def hasher(self, table: np.ndarray = IDENTITY):
        """A function (starts, ends) -> 64-bit hashes of those byte ranges, after mapping
        each byte by ``table``. A range's hash depends on its bytes alone."""
        up, down = _power(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, U64)
        np.cumsum(_BYTE[table][self.data] * up[:len(self.data)], out=sums[1:])
        return lambda starts, ends: mix((sums[ends] - sums[starts]) * down[starts])

    def per_text(self, marks: np.ndarray) -> np.ndarray:
        """Sum of a value per byte over each text."""
        return range_sums(marks, self.bounds)


def range_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def windows(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows that stay in one text, and their first words."""
    if len(hashes) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:len(doc) - n + 1] == doc[n - 1:])
    out = np.zeros(len(at), U64)
    for k in range(n):
        out = (out ^ hashes[at + k]) * _BASE
    return mix(out), at


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES, rows: int = 1 << 30) -> Iterator[Chunk]:
    """Chunks of a string column, of at most so many bytes and rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), lo + rows, len(column))
        yield Chunk(lo, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        lo = hi
