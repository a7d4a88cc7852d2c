"""SentencePiece encoding, decoding, and sampling of segmentations without replacement.

The segmentations of a text are the paths of a lattice: nodes are places between characters, edges
the pieces that match there (a character without a piece is a chain of its byte pieces). A path's
log-weight is the sum of its pieces' log-probabilities, which fall with a piece's rank as Zipf's law
has it, times ``alpha``. No piece holds a space mark behind its first character, so a lattice is a chain of the lattices of
its space-separated units; equal units share one, built for all new units of some texts at once (a trie walked
from every character a byte a step, masses summed from the ends of the units backwards).

Gumbel top-k: perturbing every path's log-probability with Gumbel noise and taking the k largest draws k
distinct paths without replacement. They are found by A* from the root, top down: a node carries the
largest perturbed value g below it. Of a node's edges, the one with the largest value is a draw by probability,
independent of g; the largest value of all paths that leave by another edge is a Gumbel of their log-mass cut off at g.
So the best path below a node is one walk, and every edge of it leaves one waiting node: "this prefix, then any other edge".
All texts of a chunk are searched together, a path a round: each takes its best waiting node, draws another of its edges, and all
units behind it are walked at once. At most k + 1 waiting nodes can matter, so no more are kept; the noise has 52 bits, so
a value is at most LEAD above its log-mass, and nodes that can't reach the kept ones get none.
The value of the best node left after k paths is the threshold t; a path of log-probability p has the inclusion score
P(p + Gumbel > t) = 1 - exp(-exp(p - t)). Noise is a hash of the row's key, the round and the place in the text, so a
row's samples don't depend on its partition or the texts beside it.

Cases: a null text is empty; an empty text has one segmentation, without pieces, of inclusion 1; with fewer
than k segmentations all are returned, with inclusion 1; equal keys and texts give equal samples; a
space mark in a text decodes as a space; a long text costs time and memory linear in its length.
"""

from __future__ import annotations

import math
import random
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.llm.shared import ship, table
from tillcast.llm.textbuf import IS_LEAD, U64, mix

SAMPLES = 3
ALPHA = 0.6
SPACE = "▁"
#: Characters of the texts searched together; a longer text is searched by itself.
CHUNK_CHARS = 2_000_000
#: Units whose lattices are kept from one chunk to the next, and their mean length at most.
KEPT_UNITS, LONGEST = 150_000, 40
#: -log of the smallest exponential noise, rounded up.
LEAD = 37.0
#: Places of a walk that get noise in any case.
FIRST = 160
SAMPLE = T.StructType([T.StructField("sample", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
                       T.StructField("logp", T.DoubleType()), T.StructField("inclusion", T.DoubleType())])

_STEP, _ROUND = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
MASK = (1 << 64) - 1
NONE, ZERO = np.zeros(0, np.int64), np.zeros(1)
_models: dict = {}


def uniforms(base: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) of 52 bits, by hash."""
    return ((mix(base) >> U64(12)).astype(np.float64) + 0.5) * 2.0 ** -52


class Pieces:
    """The pieces of a model file, as log-probabilities by string and as a trie of their bytes."""

    def __init__(self, path: str, alpha: float):
        from sentencepiece import SentencePieceProcessor

        self.processor = p = SentencePieceProcessor(model_file=path)
        byte_id, ranked = {}, {}
        for i in range(p.get_piece_size()):
            if p.is_byte(i):
                byte_id[int(p.id_to_piece(i)[3:5], 16)] = i
            elif not (p.is_control(i) or p.is_unknown(i) or p.is_unused(i)) and p.get_score(i) > -1e8:
                ranked[p.id_to_piece(i)] = (-p.get_score(i), i)
        if any(SPACE in s[1:] for s in ranked):
            raise ValueError("a piece holds a space mark behind its first character")
        total = math.log(sum(1 / (r + 2.7) for r, _ in ranked.values()))
        self.weight = {s: (-alpha * (math.log(r + 2.7) + total), i) for s, (r, i) in ranked.items()}
        self.byte_weight = -alpha * (math.log(p.get_piece_size() + 2.7) + total)
        self.byte_id = np.array([byte_id[b] for b in range(256)], np.int32)
        self.weight_of = np.full(p.get_piece_size(), self.byte_weight)
        for w, i in self.weight.values():
            self.weight_of[i] = w
        raw = [b"" if p.is_control(i) or p.is_unknown(i) else p.id_to_piece(i).encode("utf-8")
               for i in range(p.get_piece_size())]
        for b, i in enumerate(self.byte_id.tolist()):
            raw[i] = bytes([b])
        self.size = np.array([*map(len, raw)], np.int64)
        self.raw = pa.array([r.replace(SPACE.encode("utf-8"), b" ") for r in raw], pa.large_binary())
        self._trie()
        self.kept = Lattice(self)

    def _trie(self) -> None:
        """``child[node, class of the byte]`` (0: none), and the piece that ends at a node (-1: none)."""
        at, pairs, ends = {b"": 0}, [], [-1]
        for s, (_, i) in self.weight.items():
            raw = s.encode("utf-8")
            for n in range(1, len(raw) + 1):
                if raw[:n] not in at:
                    at[raw[:n]] = len(ends)
                    pairs.append((at[raw[:n - 1]], raw[n - 1], len(ends)))
                    ends.append(-1)
            ends[at[raw]] = i
        parent, byte, node = np.array(pairs, np.int64).T
        self.byte_class = np.zeros(256, np.int64)
        used = np.unique(byte)
        self.byte_class[used] = np.arange(1, len(used) + 1)
        inner = np.unique(parent)  # nodes with children come first, the root as 0
        number = np.empty(len(ends), np.int64)
        number[inner] = np.arange(len(inner))
        number[np.setdiff1d(np.arange(len(ends)), inner)] = np.arange(len(inner), len(ends))
        self.n_inner, self.width = len(inner), len(used) + 1
        self.child = np.zeros(len(inner) * self.width, np.int32)
        self.child[number[parent] * self.width + self.byte_class[byte]] = number[node]
        self.piece_at = np.empty(len(ends), np.int32)
        self.piece_at[number] = ends

    def text(self, ids) -> str:
        return self.texts(pa.array(ids, pa.int32()), [0, len(ids)])[0]

    def texts(self, ids: pa.Array, bounds: list[int]) -> list[str]:
        """Between any two bounds the pieces' bytes in a row, space marks as spaces, without the one put before the text."""
        _, ends, data = (joined := self.raw.take(ids)).buffers()
        ends = np.frombuffer(ends, np.int64, len(ids) + 1, 8 * joined.offset)[bounds].tolist() if len(ids) else [0] * len(bounds)
        data, out = memoryview(data or b""), []
        for a, b in zip(ends[:-1], ends[1:]):
            raw = str(data[a:b], "utf-8", "replace").replace(SPACE, " ")
            out.append(raw[1:] if raw[:1] == " " else raw)
        return out

    def unit(self, text: str) -> Unit:
        return Unit(text, self)


class Unit:
    """The edges of one unit read off its text: edges(i) are (end, log-weight, ids) from character i."""

    def __init__(self, text: str, pieces: Pieces):
        self.text, self.pieces = text, pieces

    def edges(self, i: int) -> list[tuple]:
        weight, out = self.pieces.weight, []
        for j in range(i + 1, len(self.text) + 1):
            hit = weight.get(self.text[i:j])
            if hit is not None:
                out.append((j, hit[0], (hit[1],)))
        if not out or out[0][0] != i + 1:
            raw = self.text[i].encode("utf-8")
            out.append((i + 1, self.pieces.byte_weight * len(raw), tuple(self.pieces.byte_id[list(raw)].tolist())))
        return out


def units_of(text: str) -> list[str]:
    return [SPACE + u for u in bare_units(text)]


def bare_units(text: str) -> list[str]:
    """The units without the space mark that each begins with."""
    return text.replace(SPACE, " ").split(" ") if text else []


class Lattice:
    """The lattices of some units. State 0 is the end of a unit; the edges of state s are those from ``off[s]`` on, with
    piece ``id``, next state ``to``, log-probability ``logp`` given the state, summed probability ``upto`` (infinite
    for the last one) and log-probability ``other`` of the state's other edges."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.n_edges = pieces, 0
        self.units = pa.array([], pa.string())  # by number, without their space marks
        self.first = np.zeros(0, np.int64)
        self.off, self.to = np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.id, self.logp, self.upto, self.other = np.zeros(0, np.int32), np.zeros(0), np.zeros(0), np.zeros(0)

    @property
    def full(self) -> bool:
        return len(self.units) > KEPT_UNITS or len(self.off) > KEPT_UNITS * LONGEST

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """Per text the numbers of its units; units not met before are added."""
        known, full = len(self.units), [n for n, t in enumerate(texts) if t]
        units = pa.compute.split_pattern(pa.compute.replace_substring(pa.array([texts[n] for n in full], pa.string()), SPACE, " "), " ")
        once = pa.concat_arrays([self.units, units.flatten()]).dictionary_encode()  # numbers by first place, so known ones stay
        numbers, self.units = once.indices.to_numpy()[known:].astype(np.int64), once.dictionary
        if len(self.units) > known:
            self._add("".join([SPACE + u for u in self.units[known:].to_numpy(zero_copy_only=False)]).encode("utf-8"))
        out, at = [numbers[:0]] * len(texts), units.offsets.to_pylist()
        for n, a, b in zip(full, at[:-1], at[1:]):
            out[n] = numbers[a:b]
        return out

    def _add(self, raw: bytes) -> None:
        p, data = self.pieces, np.frombuffer(raw, np.uint8)
        size = len(data)
        # a unit starts at each space mark and nowhere else
        mark = np.frombuffer(SPACE.encode("utf-8"), np.uint8)
        start = np.flatnonzero((data[:-2] == mark[0]) & (data[1:-1] == mark[1]) & (data[2:] == mark[2]))
        lead = np.flatnonzero(IS_LEAD[data])
        char_end = np.zeros(size, np.int64)
        char_end[lead] = np.append(lead[1:], size)
        classes = np.append(p.byte_class[data], 0)
        count, whole, found = np.zeros(size, np.int32), np.zeros(size, bool), []
        at, node, depth = lead, np.zeros(len(lead), np.int64), 0
        while len(at):
            node = p.child[node * p.width + classes[at + depth]]
            hit = np.flatnonzero(node)
            at, node, depth = at[hit], node[hit], depth + 1
            piece = p.piece_at[node]
            ends = np.flatnonzero(piece >= 0)
            here = at[ends]
            found.append((here.astype(np.int32), count[here], (here + depth).astype(np.int32), piece[ends]))
            count[here] += 1
            whole[here[char_end[here] == here + depth]] = True
            on = np.flatnonzero((node < p.n_inner) & (at + depth < size))
            at, node = at[on], node[on].astype(np.int64)
        lone = ~whole & IS_LEAD[data]  # characters without a piece: byte by byte
        lone = np.flatnonzero(lone[lead[np.cumsum(IS_LEAD[data]) - 1]])
        found.append((lone, count[lone], lone + 1, p.byte_id[data[lone]]))
        count[lone] += 1
        # states by their distance from the end of the unit, so a state's edges lead to states before it
        which = np.flatnonzero(count)
        stop, begins = np.append(start[1:], size), np.zeros(size, np.int8)
        begins[start] = 1
        away = stop[np.cumsum(begins, dtype=np.int32)[which] - 1] - which
        order = np.argsort(away.astype(np.uint16) if away.max() < 1 << 16 else away, kind="stable")
        which, away = which[order], away[order]
        base, n_old = len(self.off), self.n_edges
        state = np.zeros(size + 1, np.int64)
        state[which] = np.arange(1, 1 + len(which))
        first = state[start] + (base - 1)
        degree = count[which]
        off = np.cumsum(degree) - degree
        at_edge = np.zeros(size, np.int64)
        at_edge[which] = off
        n = int(degree.sum())
        to, piece = np.empty(n, np.int32), np.empty(n, np.int32)
        state[start] = 0
        for here, rank, end, ids in found:
            e = at_edge[here] + rank
            to[e], piece[e] = state[end], ids
        mass = np.zeros(1 + len(which))  # by new state, from 1 on; 0 is the end
        value = p.weight_of[piece]  # with the mass behind an edge, from here on
        steps = np.append(np.flatnonzero(np.diff(away, prepend=-1)), len(which)).tolist()
        for a, b in zip(steps[:-1], steps[1:]):
            x, y = off[a], off[b] if b < len(which) else n
            part, cuts = value[x:y], off[a:b] - x
            part += mass[to[x:y]]
            one = part[cuts]  # a state's edges differ by little, so any of them scales their sum
            mass[1 + a:1 + b] = one + np.log(np.add.reduceat(np.exp(part - np.repeat(one, degree[a:b])), cuts))
        logp = np.minimum(value - np.repeat(mass[1:], degree), 0.0)
        prob = np.exp(logp)
        before, after, upto = np.zeros(n), np.zeros(n), np.empty(n)
        sums, have, ranks = np.zeros(len(which)), np.arange(len(which)), []
        while len(have):
            e = off[have] + len(ranks)
            ranks.append((have, e))
            before[e] = part = sums[have]
            sums[have] = upto[e] = part + prob[e]
            have = have[degree[have] > len(ranks)]
        sums[:] = 0
        for have, e in reversed(ranks):
            after[e] = part = sums[have]
            sums[have] = part + prob[e]
        upto[off + degree - 1] = np.inf
        with np.errstate(divide="ignore"):
            other = np.log(before + after)
        self.first = np.append(self.first, first)
        self.off = np.append(self.off, off + n_old)
        found = None
        to[to > 0] += base - 1
        self.to, self.id, self.logp = np.append(self.to, to), np.append(self.id, piece), np.append(self.logp, logp)
        self.upto, self.other, self.n_edges = np.append(self.upto, upto), np.append(self.other, other), n_old + n

    def edges_of(self, state: int) -> range:
        return range(int(self.off[state]), int(self.off[state + 1]) if state + 1 < len(self.off) else self.n_edges)

    def walk(self, state: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A drawn path from each state to the end of its unit: the edges one after the other, and their bounds."""
        live = np.flatnonzero(state)
        s, b, steps, length = state[live], base[live], [], np.zeros(len(state) + 1, np.int64)
        off, upto, to = self.off, self.upto, self.to
        while len(live):
            u = uniforms(b)
            e = off[s]
            more = np.flatnonzero(u >= upto[e])
            while len(more):
                e[more] += 1
                more = more[u[more] >= upto[e[more]]]
            steps.append((live, e))
            s = to[e]
            on = np.flatnonzero(s)
            if len(on) < len(s):
                length[live + 1] = len(steps)
                live, s, b = live[on], s[on], b[on]
            b = b + U64(_STEP)
        bounds = np.cumsum(length)
        out = np.empty(bounds[-1], np.int64)
        for n, (who, e) in enumerate(steps):
            out[bounds[who] + n] = e
        return out, bounds


class Path(NamedTuple):
    """A path of one text: its edges, the log-probability up to each edge's start and of all, and where it left its parent: it has
    ``skip`` edges from there, the last of them in ``unit``; ``bounds`` are those of the units walked behind it, from its first walked edge."""

    edges: np.ndarray
    upto: np.ndarray
    parent: int
    unit: int
    skip: int
    bounds: np.ndarray


class Search:
    """The A* search of one text. A waiting node is (value, path, place, edges taken there), the worst first."""

    def __init__(self, first: np.ndarray, seed: int, hashed: int, k: int, lattice: Lattice):
        self.lattice, self.k, self.first = lattice, k, first
        self.paths: list[Path] = []
        self.seed, self.random = hashed, random.Random(seed)
        self.waiting: list[tuple] = []
        self.done = not len(first)

    def _noise(self) -> float:
        return -math.log(self.random.random() or 5e-324)

    def begin(self) -> list[np.ndarray]:
        """The states to walk from in this round, in parts."""
        lat = self.lattice
        if not self.paths:
            self.value = -math.log(self._noise())
            self.parent, self.unit, self.edges, self.before = -1, 0, NONE, ZERO
            return [self.first]
        self.value, self.parent, place, taken = self.waiting.pop()
        path = self.paths[self.parent]
        upto = float(path.upto[place])
        here = lat.edges_of(int(np.searchsorted(lat.off, path.edges[place], "right")) - 1)
        logp = lat.logp[here.start:here.stop].tolist()
        free = [e for e in here if e not in taken]
        weight = [logp[e - here.start] for e in free]
        top = max(weight)
        chance = [math.exp(w - top) for w in weight]
        u, pick = self.random.random() * sum(chance), 0
        while pick < len(free) - 1 and u >= chance[pick]:
            u -= chance[pick]
            pick += 1
        left = sum(chance[:pick] + chance[pick + 1:])
        if left:
            self.wait([(self._held(upto + top + math.log(left)), self.parent, place, (*taken, free[pick]))])
        self.unit = self._unit(self.parent, place)
        self.edges = np.append(path.edges[:place], free[pick])
        self.before = np.append(path.upto[:place + 1], upto + weight[pick])
        return [lat.to[free[pick]:free[pick] + 1], self.first[self.unit + 1:]]

    def _unit(self, number: int, place: int) -> int:
        """The unit that holds an edge of a path."""
        path = self.paths[number]
        if place >= path.skip:
            return path.unit + int(np.searchsorted(path.bounds, place - path.skip + path.bounds[0], "right")) - 1
        return path.unit if place == path.skip - 1 else self._unit(path.parent, place)

    def _held(self, mass: float) -> float:
        """A Gumbel of this log-mass, cut off at the node's value."""
        return float(mass - np.logaddexp(mass - self.value, math.log(self._noise() or 5e-324)))

    def wait(self, nodes: list[tuple]) -> None:
        room = self.k - len(self.paths)
        self.waiting = sorted(self.waiting + nodes, key=lambda n: n[0])[-room:]

    def end(self, path: Path, nodes: list[tuple]) -> None:
        """Take the walk as the next path, with those of its edges that may matter as waiting nodes."""
        self.wait(nodes)
        self.paths.append(path)
        self.done = len(self.paths) == self.k or not self.waiting

    def result(self) -> list[tuple[np.ndarray, float, float]]:
        if not len(self.first):
            return [(np.zeros(0, np.int32), 0.0, 1.0)]
        limit = self.waiting[-1][0] if self.waiting else -math.inf
        return [(self.lattice.id[path.edges], total, -math.expm1(-math.exp(min(700.0, total - limit))) if limit > -math.inf else 1.0)
                for path in self.paths for total in [float(path.upto[-1])]]


def ranges(start: list[int], size: list[int], of: np.ndarray) -> np.ndarray:
    """The numbers from each start on, one range after the other; ``of`` counts from 0 in each."""
    return np.repeat(np.array(start, np.int64), size) + of


def a_round(going: list[Search], nth: int) -> None:
    """The next path of each text."""
    lattice, room = going[0].lattice, going[0].k - nth
    parts = [s.begin() for s in going]
    size = [sum(map(len, p)) for p in parts]
    stop = np.cumsum(size)
    of = np.arange(stop[-1]) - np.repeat(stop - size, size)
    base = ranges([s.unit for s in going], size, of).astype(U64) * U64(_STEP)
    base += np.repeat(np.array([s.seed + (nth + 1) * _ROUND & MASK for s in going], U64), size)
    walked, bounds = lattice.walk(np.concatenate([x for p in parts for x in p]), mix(base))
    own = [bounds[b - n:b + 1] for n, b in zip(size, stop.tolist())]
    begin, length = [int(b[0]) for b in own], [int(b[-1] - b[0]) for b in own]
    logp = lattice.logp[walked]
    edges = np.concatenate([x for s, a, n in zip(going, begin, length) for x in (s.edges, walked[a:a + n])])
    upto = np.concatenate([x for s, a, n in zip(going, begin, length) for x in (s.before, logp[a:a + n])])
    paths, place, nodes, at = [], [], [[] for _ in going], 0
    for i, (s, n) in enumerate(zip(going, length)):
        skip = len(s.edges)
        place.append(at + i + skip)
        paths.append(Path(edges[at:at + skip + n], upto[at + i:at + i + skip + n + 1], s.parent, s.unit, skip, own[i]))
        np.add.accumulate(paths[-1].upto[skip:], out=paths[-1].upto[skip:])
        at += skip + n
    noise = [s.seed + (nth + 1) * _STEP & MASK for s in going]
    todo = [(i, 0, min(FIRST, n)) for i, n in enumerate(length) if n]
    while todo:
        which, known, to = map(list, zip(*todo))
        size = [b - a for a, b in zip(known, to)]
        stop = np.cumsum(size)
        of = ranges(known, size, np.arange(stop[-1]) - np.repeat(stop - size, size))
        edge = walked[ranges([begin[i] for i in which], size, of)]
        mass = upto[ranges([place[i] for i in which], size, of)] + lattice.other[edge]
        hashed = of.astype(U64) * U64(_ROUND) + np.repeat(np.array([noise[i] for i in which], U64), size)
        gumbel = np.log(-np.log(uniforms(mix(hashed))))
        held = mass - np.logaddexp(mass - np.repeat(np.array([going[i].value for i in which]), size), gumbel)
        todo = []
        for i, a, b, end in zip(which, known, to, stop.tolist()):
            s, path, first = going[i], paths[i], end - (b - a)
            best = first + np.argsort(held[first:end], kind="stable")[-room:]
            nodes[i] += [(h, nth, path.skip + a + j - first, (e,)) for h, m, j, e in zip(
                held[best].tolist(), mass[best].tolist(), best.tolist(), edge[best].tolist()) if m > -math.inf]
            ranked = sorted([n[0] for n in s.waiting + nodes[i]])
            low = ranked[-room] if len(ranked) >= room else -math.inf
            # a node's log-mass is at most that of its prefix, which falls along the path
            more = length[i] - int(path.upto[path.skip:-1][::-1].searchsorted(low - LEAD))
            if more > b:
                todo.append((i, b, more))
    for s, path, found in zip(going, paths, nodes):
        s.end(path, found)


def samples(texts: list[str], seeds: list[int], k: int, pieces: Pieces) -> list[list[tuple[np.ndarray, float, float]]]:
    """Per text at most k distinct segmentations by falling perturbed value: (ids, log-probability, inclusion)."""
    if pieces.kept.full:
        pieces.kept = Lattice(pieces)
    lattice = pieces.kept
    numbers, hashed = lattice.numbers(texts), mix(np.array([s & MASK for s in seeds], U64)).tolist()
    searches = [Search(lattice.first[u], s, h, k, lattice) for u, s, h in zip(numbers, seeds, hashed)]
    nth = 0
    while going := [s for s in searches if not s.done]:
        a_round(going, nth)
        nth += 1
    return [s.result() for s in searches]


def sample(text: str, seed: int, k: int, pieces: Pieces) -> list[tuple[list[int], float, float]]:
    """The samples of one text, ids as a list."""
    return [(ids.tolist(), logp, inclusion) for ids, logp, inclusion in samples([text], [seed], k, pieces)[0]]


def model(path: str, alpha: float) -> Pieces:
    if (path, alpha) not in _models:
        _models[path, alpha] = Pieces(path, alpha)
    return _models[path, alpha]


def segmented(batches: Iterator[pa.RecordBatch], k: int, pieces: Pieces) -> Iterator[pa.RecordBatch]:
    """The rows, once for each sample, with a struct column for the last two, which are text and seed; a batch for each
    CHUNK_CHARS of text, so that no more than their segmentations are held."""
    for batch in batches:
        *_, texts, seeds = batch.columns
        texts, seeds = [t or "" for t in texts.to_pylist()], seeds.to_pylist()
        at = 0
        while at < len(texts):
            stop, chars = at + 1, len(texts[at])
            while stop < len(texts) and chars + len(texts[stop]) <= CHUNK_CHARS:
                chars += len(texts[stop])
                stop += 1
            drawn = samples(texts[at:stop], seeds[at:stop], k, pieces)
            flat = [(n, *row) for rows in drawn for n, row in enumerate(rows, 1)]
            number, ids, logp, inclusion = zip(*flat)
            bounds = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            found = pa.StructArray.from_arrays(
                [pa.array(number, pa.int32()), pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(ids))),
                 pa.array(logp, pa.float64()), pa.array(inclusion, pa.float64())], ["sample", "ids", "logp", "inclusion"])
            rows = pa.array(np.repeat(np.arange(at, stop), [len(d) for d in drawn]))
            yield pa.RecordBatch.from_arrays([c.take(rows) for c in batch.columns[:-2]] + [found],
                                             [*batch.schema.names[:-2], "segmentation"])
            at = stop


def encode(text: Column, path: str) -> Column:
    """The model's own best segmentation, as an array of ids; a null text has none."""
    def run(t: pa.Array) -> pa.Array:
        return pa.array(model(path, 1.0).processor.encode([x or "" for x in t.to_pylist()], num_threads=1),
                        pa.list_(pa.int32()))
    return F.arrow_udf(run, "array<int>")(text)


def texts_of(ids: pa.Array, pieces: Pieces) -> list[str]:
    """The text of each array of ids; a null one is empty."""
    return pieces.texts(ids.flatten(), np.cumsum([0, *(n or 0 for n in pa.compute.list_value_length(ids).to_pylist())]).tolist())


def decode(ids: Column, path: str) -> Column:
    """The text of an array of ids."""
    def run(x: pa.Array) -> pa.Array:
        return pa.array(texts_of(x, model(path, ALPHA)), pa.string())
    return F.arrow_udf(run, "string")(ids)


def _seeded(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """The columns under plain names, then text and seed."""
    ship(rows.sparkSession)
    named = rows.select("*", F.col(text).alias("text"), F.xxhash64(*key).alias("seed"))
    return named.toDF(*[f"c{i}" for i in range(len(named.columns))])


def sampled(rows: DataFrame, path: str, key: list[str], text: str = "text", k: int = SAMPLES,
            alpha: float = ALPHA, out: str = "segmentation") -> DataFrame:
    """A row for each sampled segmentation, with a struct column: sample (from 1), ids, logp, inclusion."""
    def run(batches):
        return segmented(batches, k, model(path, alpha))

    named = _seeded(rows, key, text)
    schema = T.StructType([*named.schema.fields[:-2], T.StructField("segmentation", SAMPLE)])
    kept = [(f"c{i}", name) for i, name in enumerate(rows.columns) if name != out]
    return named.mapInArrow(run, schema).select(*[F.col(c).alias(name) for c, name in kept], F.col("segmentation").alias(out))


def checksum_column(ids: pa.Array) -> pa.Array:
    """CRC-32 of each array of ids as little-endian 32-bit numbers."""
    flat, at = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes(), [0]
    for n in pa.compute.list_value_length(ids).to_pylist():
        at.append(at[-1] + 4 * n)
    return pa.array([zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:])], pa.int64())


def _drawn(rows: DataFrame, key: list[str]) -> DataFrame:
    """Counts and checksums of the samples; ``round_trip`` tells that the pieces decode to the text."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")

    def run(batches):
        pieces = model(path, ALPHA)
        for batch in segmented(batches, SAMPLES, pieces):
            *keys, text, found = batch.columns
            ids = found.field("ids")
            same = [a == (b or "") for a, b in zip(texts_of(ids, pieces), text.to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*keys, found.field("sample"), pa.compute.list_value_length(ids).cast(pa.int64()), checksum_column(ids),
                 found.field("logp"), found.field("inclusion"), pa.array(same, pa.bool_())], names)

    rows = rows.select(*key, "text")
    names = [*key, "sample", "n_pieces", "ids_crc32", "logp", "inclusion", "round_trip"]
    types = [*[f.dataType for f in rows.schema.fields[:-1]], T.IntegerType(), T.LongType(), T.LongType(),
             T.DoubleType(), T.DoubleType(), T.BooleanType()]
    return _seeded(rows, key, "text").mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in zip(names, types)]))


def op9_sentencepiece_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn(table(spark, sf_dir, "documents"), ["doc_id"])


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drawn(table(spark, sf_dir, "conversations"), ["conv_id", "turn"])
