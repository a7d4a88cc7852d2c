"""Second-order boosted trees with a learned direction for missing values (M3).

A tree grows level by level. Rows are kept as blocks of bins, in which rows with the same label and bins are one, with their
number (days without sales around them differ in few features). In a level, every task adds up
gradients and curvatures per (node, feature, bin) of its blocks, of the smaller one of two children only, and sends at most nodes x features x bins
rows, however many it reads; their sums come to the driver (82,240 rows for 8 nodes, 40 features and 257 bins), where the
larger child is what its parent has left. There, running sums over the bins of a node's feature
give the gain of every cut, with the missing values (a bin of their own) once on either side; the
better side is the one that missing values take from then on, in the fit and in predictions.

Squared error: gradient ``prediction - label``, curvature 1. A cut's gain is
``(GL^2/(HL+l) + GR^2/(HR+l) - G^2/(H+l)) / 2``, a leaf's weight ``-G/(H+l)``. Gradients are rounded to
whole multiples of a power of ten before they are added, so a fit depends neither on the number of
tasks nor on which of them ran twice. Equal gains go to the first feature, the lowest cut,
and missing values to the right.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.session import deleted, table_path, written

#: Fixed values of the reference model, and the defaults of its library.
DEPTH, RATE, ROUNDS = 5, 0.1, 50
LAMBDA, GAMMA, MIN_CHILD, BINS = 1.0, 0.0, 1.0, 256
#: Rounds after which the predictions so far are written, which bounds the trees that a row walks again in every level.
CUT_ROUNDS = 2
#: Rows of a block, rows of a task among which equal ones are counted, and rows (before that) of a part in which tasks' rows meet.
BLOCK, WINDOW, PART = 1 << 15, 1 << 21, 1 << 20
_STEP = 16


@dataclass
class Tree:
    """Cuts by node (the root is 1, the children of i are 2i and 2i + 1) as (feature number, threshold,
    missing_left, gain); weight and rows of every node."""

    cuts: dict[int, tuple[int, float, bool, float]] = field(default_factory=dict)
    weights: dict[int, float] = field(default_factory=dict)
    rows: dict[int, int] = field(default_factory=dict)

    def node(self, x: str, depth: int) -> str:
        """SQL for the node in which a row with the values ``x`` (an array column) ends. The tree is literal arrays, which
        generated code refers to, so that the code of one level serves every tree."""
        every = range(1, 1 << depth)
        feature = _literal("int", [self.cuts[n][0] + 1 if n in self.cuts else 0 for n in every])
        threshold = _literal("double", [self.cuts[n][1] if n in self.cuts else 0.0 for n in every])
        missing = _literal("int", [int(n in self.cuts and not self.cuts[n][2]) for n in every])
        value = f"element_at({x}, element_at({feature}, n))"
        side = f"CASE WHEN {value} IS NULL THEN element_at({missing}, n) WHEN {value} <= element_at({threshold}, n) THEN 0 ELSE 1 END"
        return (f"aggregate(sequence(1, {depth}), 1, (n, d) -> CASE WHEN n >= {1 << depth} THEN n "
                f"WHEN element_at({feature}, n) = 0 THEN n ELSE 2 * n + {side} END)")

    def arrays(self, depth: int, rate: float) -> tuple[np.ndarray, ...]:
        """Feature (-1 at a leaf), threshold and side of missing values (1: right) by node, and every node's weight times the rate."""
        every = range(1 << depth)
        value = [rate * self.weights.get(n, 0.0) for n in range(2 << depth)]
        for n in every:
            if n not in self.cuts:  # a row that ends here goes on to the left, with the leaf's weight
                value[2 * n:2 * n + 2] = [value[n]] * 2
        return (np.array([self.cuts[n][0] if n in self.cuts else -1 for n in every]),
                np.array([self.cuts[n][1] if n in self.cuts else 0 for n in every]),
                np.array([n in self.cuts and not self.cuts[n][2] for n in every]), np.array(value))

    def value(self, x: str, depth: int, rate: float) -> str:
        """SQL for the weight of that node, times the rate."""
        weights = _literal("double", [rate * self.weights.get(n, 0.0) for n in range(1, 2 << depth)])
        return f"element_at({weights}, {self.node(x, depth)})"


def _literal(kind: str, values: list) -> str:
    return "array(" + ", ".join(f"{kind}('{v!r}')" if kind == "double" else str(v) for v in values) + ")"


@dataclass
class Boosted:
    features: list[str]
    base: float
    rate: float
    trees: list[Tree]

    depth: int = DEPTH

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """df with the prediction; features are read as double, a missing one goes the learned way."""
        x = df.withColumn("_x", F.array(*[F.col(f).cast("double") for f in self.features])).withColumn(out, F.lit(self.base))
        for tree in self.trees:
            x = x.withColumn(out, F.col(out) + F.expr(tree.value("_x", self.depth, self.rate)))
        return x.drop("_x")

    def predict_batches(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """As :meth:`predict`, in Arrow batches: for many trees."""
        names, trees, depth, base = self.features, [t.arrays(self.depth, self.rate) for t in self.trees], self.depth, self.base

        def run(batches):
            for b in batches:
                rows = b.num_rows
                x, none = np.zeros((len(names), rows)), np.zeros((len(names), rows), bool)
                for f, name in enumerate(names):
                    col = b.column("_x" + str(f))
                    none[f] = col.is_null().to_numpy(zero_copy_only=False)
                    x[f] = col.to_numpy(zero_copy_only=False)
                p, row = np.full(rows, base), np.arange(rows)
                for feature, cut, missing, value in trees:
                    at, leaf = np.ones(rows, np.int64), feature < 0
                    for _ in range(depth):
                        i = np.maximum(feature, 0).take(at) * rows + row
                        right = np.where(none.take(i), missing.take(at), ~(x.take(i) <= cut.take(at)))
                        at = 2 * at + (right & ~leaf.take(at))
                    p = p + value.take(at)
                kept = b.num_columns - len(names)
                yield pa.RecordBatch.from_arrays([*b.columns[:kept], pa.array(p)], names=[*b.schema.names[:kept], out])
        schema = T.StructType([*[x for x in df.schema if x.name != out], T.StructField(out, T.DoubleType())])
        return df.drop(out).select("*", *[F.col(f).cast("double").alias(f"_x{k}") for k, f in enumerate(names)]).mapInArrow(run, schema)

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per node: its cut (NULL at a leaf), rows of the fit, and the weight of a leaf after the rate."""
        rows = []
        for t, tree in enumerate(self.trees):
            for n in sorted(tree.rows):
                cut = tree.cuts.get(n)
                way = (self.features[cut[0]], cut[1], "left" if cut[2] else "right", cut[3]) if cut else (None,) * 4
                rows.append((t, n, *way, tree.rows[n], None if cut else self.rate * tree.weights[n]))
        return spark.createDataFrame(rows, "tree int, node int, feature string, threshold double, missing string,"
                                           " gain double, n long, value double")

    def importance(self, spark: SparkSession) -> DataFrame:
        """Per feature the number of its cuts and their mean gain, most cuts first (ties by name)."""
        gains: dict[str, list[float]] = {f: [] for f in self.features}
        for tree in self.trees:
            for feature, _, _, gain in tree.cuts.values():
                gains[self.features[feature]].append(gain)
        order = sorted(gains, key=lambda f: (-len(gains[f]), f))
        return spark.createDataFrame([(f, len(gains[f]), sum(gains[f]) / len(gains[f]) if gains[f] else 0.0, k) for k, f in enumerate(order, 1)],
                                     "feature string, cuts int, mean_gain double, rank int")


def cut_points(df: DataFrame, features, bins: int) -> dict[str, list[float]]:
    """At most ``bins`` ascending values per feature, between which a tree may cut: all values of a feature
    that has few, quantiles of a sketch else. Features x bins numbers come to the driver."""
    wide = df.agg(*[F.approx_count_distinct(f).alias(f) for f in features]).first().asDict()
    steps = [k / bins for k in range(1, bins + 1)]
    parts = [F.array_sort(F.collect_set(f)) if wide[f] <= bins * 0.8 else F.percentile_approx(f, steps, 100 * bins) for f in features]
    found = df.agg(*[p.alias(f) for p, f in zip(parts, features)]).first()
    return {f: sorted(set(found[f] or [])) for f in features}


def bin_of(x: Column, cuts: list[float]) -> Column:
    """How many cuts lie below x (NULL for a missing x), looked up in two steps."""
    below = lambda cut: cut < x
    if not cuts:
        return F.when(x.isNotNull(), 0)
    whole = F.array(*map(F.lit, cuts))
    if len(cuts) <= _STEP:
        return F.when(x.isNotNull(), F.size(F.filter(whole, below)))
    block = F.size(F.filter(F.array(*map(F.lit, cuts[_STEP - 1::_STEP])), below))
    return F.when(x.isNotNull(), _STEP * block + F.size(F.filter(F.slice(whole, _STEP * block + 1, F.lit(_STEP)), below)))


# The functions that tasks run are made inside others, with NumPy and plain values only, so that executors need no installation.

def _counted(base: float) -> Callable:
    """Labels, numbers of rows and bins (feature by feature) -> the keys of the rows, ascending, and the columns of their
    blocks; equal rows are one. Rows of one key that differ may keep equal ones apart, but are never taken for equal."""
    def run(y, n, x):
        key = y.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for col in x:
            key ^= key >> np.uint64(29)
            key = (key + col.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(32)
        order = np.argsort(key)
        key, y, x = key[order], y[order], x[:, order]
        first = np.ones(len(y), bool)
        first[1:] = (y[1:] != y[:-1]) | (x[:, 1:] != x[:, :-1]).any(0)
        first = np.flatnonzero(first)
        n = np.add.reduceat(n[order], first) if len(first) else n
        return key[first], (y[first], np.full(len(first), base), n, x[:, first])
    return run


def _packed(cuts: list[list[float]], base: float, kind: str, parts: int = 1) -> Callable:
    """(label, features) -> blocks (labels, predictions, numbers of rows, bins) and their part of the keys: how many cuts lie
    below each feature, -1 for a missing one. Equal rows among ``WINDOW`` become one, with their number."""
    cuts, counted = [np.array(c, float) for c in cuts], _counted(base)

    def blocks(ys, xs):
        y = np.concatenate(ys)
        key, cols = counted(y, np.ones(len(y), np.int64), np.concatenate(xs, 1))
        ends = [*np.searchsorted(key >> np.uint64(32), [(k << 32) // parts for k in range(parts)]), len(key)]
        for part, (lo, hi) in enumerate(zip(ends, ends[1:])):
            for at in range(lo, hi, BLOCK):
                yield pa.RecordBatch.from_arrays([*(pa.array([c[..., at:min(at + BLOCK, hi)].tobytes()], pa.binary()) for c in cols),
                                                  pa.array([part], pa.int32())], names=["_y", "_p", "_n", "_bins", "_part"])

    def run(batches):
        ys, xs, rows = [], [], 0
        for b in batches:
            x = np.empty((len(cuts), b.num_rows), kind)
            for f, c in enumerate(cuts):
                col = b.column(f + 1)
                x[f] = np.searchsorted(c, col.to_numpy(zero_copy_only=False), "left")
                if col.null_count:
                    x[f, col.is_null().to_numpy(zero_copy_only=False)] = -1
            ys.append(b.column(0).to_numpy() + 0.0)
            xs.append(x)
            rows += b.num_rows
            if rows >= WINDOW:
                yield from blocks(ys, xs)
                ys, xs, rows = [], [], 0
        if rows:
            yield from blocks(ys, xs)
    return run


def _merged(width: int, base: float, kind: str) -> Callable:
    """The blocks of one part from all tasks -> its blocks, in which equal rows are one."""
    counted = _counted(base)

    def run(rows):
        y, n, x = ([np.frombuffer(v.as_buffer(), t) for v in rows.column(c)] for c, t in (("_y", "f8"), ("_n", "i8"), ("_bins", kind)))
        _, cols = counted(np.concatenate(y), np.concatenate(n), np.concatenate([v.reshape(width, -1) for v in x], 1))
        at = range(0, len(cols[0]), BLOCK)
        return pa.table([pa.array([c[..., k:k + BLOCK].tobytes() for k in at], pa.binary()) for c in cols], names=["_y", "_p", "_n", "_bins"])
    return run


def _reader(width: int, kind: str, depth: int, grown: list[tuple[np.ndarray, ...]]) -> tuple[Callable, Callable]:
    """``read``: a batch -> of every block its labels, predictions after the trees ``grown`` since they were written, numbers
    of rows, and bins; ``end``: the node of a level in which every row ends (below a leaf: any of those below it)."""
    def end(x, tree, level):
        feature, cut, missing, _ = tree
        # a missing value (-1) goes right where it is below 0; at a leaf all go left
        feature, low = np.maximum(feature, 0), np.where(missing, 0, -1).astype(kind)
        high = np.where(tree[0] < 0, np.iinfo(kind).max, cut).astype(kind)
        flat, rows = x.ravel(), x.shape[1]
        at, row = np.ones(rows, np.int64), np.arange(rows)
        for _ in range(level):
            v = flat.take(feature.take(at) * rows + row)
            at = 2 * at + ((v > high.take(at)) | (v < low.take(at)))
        return at

    def read(b):
        for k in range(b.num_rows):
            y, p, n, x = (np.frombuffer(b.column(c)[k].as_buffer(), t) for c, t in enumerate(("f8", "f8", "i8", kind)))
            x = x.reshape(width, -1)
            for tree in grown:
                p = p + tree[3].take(end(x, tree, depth))
            yield y, p, n, x
    return read, end


def _predicted(read: Callable) -> Callable:
    """The same blocks with their predictions so far."""
    def run(batches):
        for b in batches:
            for k, (_, p, _, _) in enumerate(read(b)):
                one = b.slice(k, 1)
                yield pa.RecordBatch.from_arrays([one.column(0), pa.array([p.tobytes()], pa.binary()), one.column(2), one.column(3)],
                                                 names=["_y", "_p", "_n", "_bins"])
    return run


def _cells(read: Callable, end: Callable, width: int, bins: int, level: int, tree: tuple[np.ndarray, ...], scale: float,
           asked: list[int] | None = None) -> Callable:
    """Sums (node, feature, bin, g, h) of a task's rows in the nodes of a level (those ``asked``, else all)."""
    def run(batches):
        first, cells = 1 << level, width * (bins + 2)  # bins 0 to the number of cuts, and one of missing values
        nodes = np.arange(first, 2 * first) if asked is None else np.array(asked)
        place = np.full(2 * first, -1)
        place[nodes] = np.arange(len(nodes)) * (bins + 2)
        g, h = (np.zeros((len(nodes), width, bins + 2), np.int64) for _ in range(2))
        size = len(nodes) * (bins + 2)
        for b in batches:
            for y, p, n, x in read(b):
                node = place.take(end(x, tree, level))
                whole = np.rint((p - y) * scale)
                if node.min(initial=0) < 0:
                    mine = np.flatnonzero(node >= 0)
                    node, whole, n, x = node[mine], whole[mine], n[mine], x.take(mine, 1)
                whole = whole.astype(np.int64) * n
                high = whole >> 26  # either part of a block's sum is exact in doubles
                parts = [(whole, 1)] if np.abs(whole).sum(dtype=float) < 2.0 ** 52 else [(high, 1 << 26), (whole - (high << 26), 1)]
                node += 1
                for f in range(width):
                    at = node + x[f]
                    h[:, f] += np.bincount(at, n, size).astype(np.int64).reshape(len(nodes), -1)
                    for part, times in parts:
                        g[:, f] += np.bincount(at, part, size).astype(np.int64).reshape(len(nodes), -1) * times
        g, h = g.ravel(), h.ravel()
        found = np.flatnonzero(h)
        if len(found):
            bin_ = found % (bins + 2) - 1
            yield pa.RecordBatch.from_arrays([
                pa.array(nodes[found // cells].astype("int32")), pa.array((found % cells // (bins + 2)).astype("int32")),
                pa.array(bin_.astype("int32"), mask=bin_ < 0), pa.array(g[found]), pa.array(h[found])], names=["node", "feature", "bin", "g", "h"])
    return run


def _dense(sums: pa.Table, nodes, width: int, bins: int) -> dict[int, np.ndarray]:
    """Sums (node, feature, bin, g, h) -> by node (one of ``nodes``) an array (g or h, feature, bin + 1)."""
    node, feature, g, h = (sums.column(c).to_numpy() for c in ("node", "feature", "g", "h"))
    bin_ = sums.column("bin").fill_null(-1).to_numpy() + 1
    out = {k: np.zeros((2, width, bins + 2), np.int64) for k in nodes}
    for k, cells in out.items():
        mine = node == k
        cells[0, feature[mine], bin_[mine]], cells[1, feature[mine], bin_[mine]] = g[mine], h[mine]
    return out


def _rows(cells: dict[int, np.ndarray]) -> pa.Table:
    """The opposite: a row for every cell that has rows."""
    parts = []
    for k, (g, h) in cells.items():
        f, b = np.nonzero(h)
        parts.append(pa.table([pa.array(np.full(len(f), k, "int32")), pa.array(f.astype("int32")), pa.array((b - 1).astype("int32"), mask=b == 0),
                               pa.array(g[f, b]), pa.array(h[f, b])], names=["node", "feature", "bin", "g", "h"]))
    return pa.concat_tables(parts).combine_chunks()


def best_cuts(sums: pa.Table, scale: float, lam: float, gamma: float, min_child: float) -> dict[int, dict]:
    """Sums (node, feature, bin, g, h) of a level -> the best cut of every node that has one: feature, bin,
    missing_left, gain, and the sums gl, hl, gr, hr of either side."""
    sums = sums.sort_by([("node", "ascending"), ("feature", "ascending"), ("bin", "ascending")])  # nulls come last
    node, feature, g, h = (sums.column(c).to_numpy() for c in ("node", "feature", "g", "h"))
    known = sums.column("bin").is_valid().to_numpy()
    bins = sums.column("bin").fill_null(-1).to_numpy()
    if not len(node):
        return {}
    first = np.concatenate(([True], (node[1:] != node[:-1]) | (feature[1:] != feature[:-1])))
    group, start = np.cumsum(first) - 1, np.flatnonzero(first)

    def parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sum up to each bin, of the missing values, and of all, of its node and feature."""
        run = np.cumsum(x)
        return run - (run - x)[start][group], np.add.reduceat(np.where(known, 0, x), start)[group], np.add.reduceat(x, start)[group]

    def term(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return g * g / (h + lam)

    (low_g, none_g, all_g), (low_h, none_h, all_h) = parts(g), parts(h)
    out: dict[int, dict] = {}
    for missing_left in (False, True):
        gl, hl = low_g + missing_left * none_g, low_h + missing_left * none_h
        gr, hr = (all_g - gl) / scale, (all_h - hl).astype(float)
        gl, hl = gl / scale, hl.astype(float)
        gain = (term(gl, hl) + term(gr, hr) - term(all_g / scale, all_h.astype(float))) * 0.5
        able = np.flatnonzero(known & (hl >= min_child) & (hr >= min_child) & (gain > gamma))
        able = able[np.lexsort((bins[able], feature[able], -gain[able], node[able]))]
        for i in able[np.unique(node[able], return_index=True)[1]]:
            cut = dict(feature=int(feature[i]), bin=int(bins[i]), missing_left=missing_left, gain=float(gain[i]),
                       gl=float(gl[i]), hl=float(hl[i]), gr=float(gr[i]), hr=float(hr[i]))
            order = lambda c: (-c["gain"], c["feature"], c["bin"], c["missing_left"])
            out[int(node[i])] = min(cut, out.get(int(node[i]), cut), key=order)
    return out


def fit(train: DataFrame, features, label: str, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, lam: float = LAMBDA,
        gamma: float = GAMMA, min_child: float = MIN_CHILD, bins: int = BINS) -> Boosted:
    """Boosted trees on numeric features, of which any may be NULL; rows without a label take no part."""
    features = list(features)
    rows = written(train.where(F.col(label).isNotNull()).select(
        F.col(label).cast("double").alias("_y"), *[F.col(f).cast("double").alias(f) for f in features]))
    n, mean, low, high = rows.agg(F.count("*"), F.avg("_y"), F.min("_y"), F.max("_y")).first()
    if not n:
        return Boosted(features, 0.0, rate, [], depth)
    base = round(mean * 1e6) / 1e6
    # Gradients are whole multiples of 1 / scale, and a sum of n of them stays within 64 bits.
    scale = 10.0 ** min(6, math.floor(math.log10(2.0 ** 61 / (n * max(high - low, 1.0) * 4))))
    cuts = cut_points(rows, features, bins)
    kind = "<i2" if bins < 1 << 14 else "<i4"
    known, width = [cuts[f] for f in features], len(features)
    most, columns = max(map(len, known), default=0), "_y binary, _p binary, _n binary, _bins binary"
    path = table_path(train.sparkSession)
    packed = rows.select("_y", *features).mapInArrow(_packed(known, base, kind, -(-n // PART)), f"{columns}, _part int")
    state = written(packed.groupBy("_part").applyInArrow(_merged(width, base, kind), columns), path)
    trees, grown = [], []  # grown since the predictions were written
    for done in range(1, rounds + 1):
        tree = Tree()
        read, end = _reader(width, kind, depth, grown)
        above: dict[int, np.ndarray] = {}
        for level in range(depth):
            # of two children the one with fewer rows is added up; the other is the rest of their parent
            few = {min(2 * k, 2 * k + 1, key=lambda c: tree.rows[c]): k for k in tree.cuts if k >= 1 << level >> 1} if level else {1: 0}
            cells = state.mapInArrow(_cells(read, end, width, most, level, tree.arrays(depth, rate), scale, list(few)),
                                     "node int, feature int, bin int, g long, h long")
            sums = cells.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
            here = _dense(sums.toArrow(), few, width, most)  # nodes x features x bins rows
            if level:
                here |= {k ^ 1: above[parent] - here[k] for k, parent in few.items()}
            above = here
            found = best_cuts(_rows(here), scale, lam, gamma, min_child)
            for k, r in found.items():
                tree.cuts[k] = (r["feature"], r["bin"], r["missing_left"], r["gain"])
                for child, gs, hs in ((2 * k, r["gl"], r["hl"]), (2 * k + 1, r["gr"], r["hr"])):
                    tree.weights[child], tree.rows[child] = -gs / (hs + lam), int(hs)
                if k == 1:
                    tree.weights[1], tree.rows[1] = -(r["gl"] + r["gr"]) / (n + lam), n
            if not found:
                break
        if not tree.cuts:  # no cut gains anything any more
            break
        grown = [*grown, tree.arrays(depth, rate)]
        if done % CUT_ROUNDS == 0 and done < rounds:
            old, path = path, table_path(train.sparkSession)
            state, grown = written(state.mapInArrow(_predicted(_reader(width, kind, depth, grown)[0]), columns), path), []
            deleted(train.sparkSession, old)
        # in the model a cut is a value: bin <= b means x <= cuts[b]
        trees.append(Tree({k: (f, cuts[features[f]][b], m, gain) for k, (f, b, m, gain) in tree.cuts.items()}, tree.weights, tree.rows))
    return Boosted(features, base, rate, trees, depth)
