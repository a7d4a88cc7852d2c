"""An FM-index over a sequence of symbols, with all queries in bulk (numpy).

The sequence holds symbols from 1 on and separators (0), of which the last symbol is one. Suffixes are
ordered with every separator a symbol of its own, by place, so no suffix goes on past the end of
its run. The Burrows-Wheeler transform lies in a wavelet matrix: a bit vector a level, with counts
per 64 bits, gives the symbol of a row and its rank in steps as many as a symbol has bits. Every
``SAMPLE``-th position and every run's first one is kept, from which others are reached.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16
U64 = np.uint64


class Bits:
    """A bit vector with the number of ones before a place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        packed = np.concatenate((packed, np.zeros(-len(packed) % 8 + 8, np.uint8)))
        self.words = packed.view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))[:-1]

    def ones(self, at: np.ndarray) -> np.ndarray:
        block, bit = at >> 6, (at & 63).astype(U64)
        return self.before[block] + np.bitwise_count(self.words[block] & ((U64(1) << bit) - U64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(U64) & U64(1)).astype(bool)


class Wavelet:
    """Rank and access over a sequence of symbols below 2**levels."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.bits, self.zeros = levels, [], []
        for level in range(levels - 1, -1, -1):
            one = (symbols >> level & 1).astype(bool)
            self.bits.append(Bits(one))
            self.zeros.append(len(one) - int(one.sum()))
            symbols = np.concatenate((symbols[~one], symbols[one]))
        self.first = np.searchsorted(self._key(symbols), self._key(np.arange(1 << levels)))

    def _key(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols with their bits in reverse, the order in which they lie after the last level."""
        out = np.zeros(len(symbols), np.int64)
        for level in range(self.levels):
            out |= (symbols.astype(np.int64) >> level & 1) << (self.levels - 1 - level)
        return out if len(out) < 1 << self.levels else out

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol lies before a place."""
        for bits, zeros, level in zip(self.bits, self.zeros, range(self.levels - 1, -1, -1)):
            ones = bits.ones(at)
            at = np.where(symbol >> level & 1, zeros + ones, at - ones)
        return at - self.first[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at a place, and how often it lies before it."""
        symbol = np.zeros(len(at), np.int64)
        for bits, zeros in zip(self.bits, self.zeros):
            ones, one = bits.ones(at), bits.get(at)
            at = np.where(one, zeros + ones, at - ones)
            symbol = symbol << 1 | one
        return symbol, at - self.first[symbol]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes by doubling; separators (0) are smaller than symbols, and ordered by place."""
    n, gap = len(text), text == 0
    start = np.where(gap, np.cumsum(gap) - 1, text + int(gap.sum()))
    _, rank = np.unique(start, return_inverse=True)
    step = 1
    while True:
        key = rank * (n + 1)
        key[:n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class Index:
    def __init__(self, text: np.ndarray):
        text = text.astype(np.int64)
        order = suffix_array(text)
        bwt = text[order - 1]
        levels = max(1, int(text.max(initial=1)).bit_length())
        self.n, self.wavelet = len(text), Wavelet(bwt, levels)
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=1 << levels))))
        marked = (order % SAMPLE == 0) | (bwt == 0)
        self.marked, self.sampled = Bits(marked), order[marked]

    def count(self, patterns: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the rows [low, high) of suffixes that begin with each pattern (a row of
        symbols from 1 on, of which the first length count)."""
        low, high = np.zeros(len(length), np.int64), np.full(len(length), self.n, np.int64)
        for step in range(int(length.max(initial=0))):
            live = np.flatnonzero((step < length) & (low < high))
            symbol = patterns[live, length[live] - 1 - step].astype(np.int64)
            there = symbol < len(self.starts) - 1
            high[live[~there]] = low[live[~there]]
            live, symbol = live[there], symbol[there]
            both = self.starts[symbol]
            low[live], high[live] = (both + self.wavelet.rank(symbol, low[live]), both + self.wavelet.rank(symbol, high[live]))
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row's suffix: steps back until a sampled position."""
        out, steps, live = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        at = rows.copy()
        while len(live):
            done = self.marked.get(at[live])
            ended = live[done]
            out[ended] = self.sampled[self.marked.ones(at[ended])] + steps[ended]
            live = live[~done]
            symbol, before = self.wavelet.access(at[live])
            at[live] = self.starts[symbol] + before
            steps[live] += 1
        return out
