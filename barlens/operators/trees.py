"""The forest of feature elimination over binned rows.

Elimination refits a forest for every feature that goes.  MLlib's learner reads the vectors, seeks split points and deals
bags anew at each refit, and ships the statistics of every node through a shuffle.  Here the rows are binned once, at MLlib's own split
points, into cached blocks of a byte per cell; a level of all trees is one pass in which every block counts its bins with numpy, and the counts are
summed (by a tree of tasks where there are many blocks).  Split rule, stopping rules and importances are those of MLlib.
"""

from __future__ import annotations

import math
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: bins per feature: MLlib's default, as all models here use it
BINS = 32

#: cells (rows x features, a byte each) of a block of binned rows
TREE_CELLS = 4_000_000

#: rows from which split points are taken, as in MLlib (``max(maxBins ** 2, 10000)``)
SPLIT_ROWS = 10_000

#: blocks' sums that the driver adds up itself; more of them are summed by a tree of tasks
DIRECT_SUMS = 16


@dataclass
class Tree:
    """Nodes by number (0 is the root): feature (-1 for a leaf), the bin up to which rows go left, children, gain of the split
    and the node's rows by class."""

    feature: list = field(default_factory=list)
    upto: list = field(default_factory=list)
    left: list = field(default_factory=list)
    gain: list = field(default_factory=list)
    stats: list = field(default_factory=list)

    def add(self, stats) -> int:
        for column, v in ((self.feature, -1), (self.upto, 0), (self.left, -1), (self.gain, 0.0), (self.stats, stats)):
            column.append(v)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, upto: int, gain: float, left, right) -> tuple[int, int]:
        self.feature[node], self.upto[node], self.gain[node] = feature, upto, gain
        self.left[node] = self.add(left)
        return self.left[node], self.add(right)

    def shape(self) -> tuple:
        """What rows need to find their node; the right child follows the left one."""
        return self.feature, self.upto, self.left


# what runs in tasks is nested, so that it travels by value and executors need not import this module
def _split_points():
    def points(values: np.ndarray, most: int) -> np.ndarray:
        v, n = np.unique(values, return_counts=True)
        middle = (v[:-1] + v[1:]) / 2.0
        if len(middle) <= most:
            return middle
        stride, out = len(values) / (most + 1), []
        target, total = stride, np.cumsum(n)
        for k in range(1, len(v)):
            if abs(total[k - 1] - target) < abs(total[k] - target):
                out.append(middle[k - 1])
                target += stride
        return np.array(out)

    return points


def _rows_in_nodes():
    def walk(shape, bins, rows):
        """(node, its rows) for every node that has no split yet; ``rows`` may repeat."""
        feature, upto, left = shape
        todo = [(0, rows)]
        while todo:
            node, r = todo.pop()
            if feature[node] < 0:
                yield node, r
            else:
                low = bins[feature[node]].take(r) <= upto[node]
                todo += [(left[node], r[low]), (left[node] + 1, r[~low])]

    return walk


def split_points(rows: DataFrame, n_rows: int, most: int, seed: int) -> dict[int, np.ndarray]:
    """Split points per feature of ``rows`` (label, features as an array), each found in the task that holds the feature."""
    points = _split_points()

    def columns(batches):
        for b in batches:
            if b.num_rows:
                x = b.column("features").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([pa.array(range(x.shape[1]), pa.int32()), pa.array([c.tobytes() for c in x.T], pa.binary())],
                                                 ["feature", "cells"])

    part = rows if n_rows <= SPLIT_ROWS else rows.sample(False, SPLIT_ROWS / n_rows, seed)
    parts = part.mapInArrow(columns, "feature int, cells binary").rdd.map(lambda r: (r["feature"], r["cells"]))
    tasks = min(8, parts.getNumPartitions())
    return dict(parts.groupByKey(tasks).mapValues(lambda c: points(np.concatenate([np.frombuffer(x) for x in c]), most)).collect())


@dataclass
class Binned:
    """``blocks``: an RDD of (bins by feature and row, label, bags by sample and row)."""

    blocks: RDD
    n_classes: int


@contextmanager
def binned(matrix: DataFrame, bags: int, seed: int):
    """The rows of a checkpointed matrix as cached blocks of bins.  ``bags``: with every row, how often it is in
    each of that many bootstrap samples, drawn once as MLlib draws the same ones at each refit."""
    rows = matrix.select("label", vector_to_array("features").alias("features"))
    size = rows.agg(F.count("*").alias("rows"), F.max(F.size("features")).alias("width"), F.max("label").alias("top"),
                    F.count(F.when((F.col("label") >= 0) & (F.col("label") % 1 == 0), 1)).alias("classed")).first()
    n, width = size["rows"], size["width"] or 0
    if not n or size["classed"] != n:  # as MLlib
        raise ValueError(f"a forest needs rows with a class each: {size['classed']} of {n}")
    found = split_points(rows, n, min(BINS, n) - 1, seed)
    cuts = [found.get(f, np.empty(0)) for f in range(width)]
    tasks = math.ceil(n * width / TREE_CELLS)
    have = rows.rdd.getNumPartitions()
    rows = rows.coalesce(tasks) if tasks <= have else rows.repartition(tasks)
    step = max(1, TREE_CELLS // width)

    def bins(batches):
        for b in batches:
            if b.num_rows:
                x = b.column("features").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                if not np.isfinite(x).all():
                    raise ValueError("a forest needs features that are finite")  # as MLlib
                cells = np.array([np.searchsorted(c, v) for c, v in zip(cuts, x.T)], np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([b.column("label").to_numpy(zero_copy_only=False).tobytes()], pa.binary()),
                                                  pa.array([cells.tobytes()], pa.binary())], ["n", "label", "bins"])

    def gather(part, batches):
        held, k = [], 0

        def block():
            y = np.concatenate([y for y, _ in held])
            b = np.concatenate([b for _, b in held], axis=1)
            return b, y, np.random.default_rng([seed, part, k]).poisson(1.0, (bags, len(y))).astype(np.uint8)

        for r in batches:
            held.append((np.frombuffer(r["label"]), np.frombuffer(r["bins"], np.uint8).reshape(-1, r["n"])))
            if sum(len(y) for y, _ in held) >= step:
                yield block()
                held, k = [], k + 1
        if held:
            yield block()

    blocks = rows.mapInArrow(bins, "n long, label binary, bins binary").rdd.mapPartitionsWithIndex(gather).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield Binned(blocks, int(size["top"]) + 1)
    finally:
        blocks.unpersist()


def _summed(blocks: RDD, f):
    def run(part):
        total = None
        for b in part:
            total = f(*b) if total is None else total + f(*b)
        return [] if total is None else [total]

    sums = blocks.mapPartitions(run)
    if sums.getNumPartitions() <= DIRECT_SUMS:  # one stage
        return sum(sums.collect())
    return sums.treeReduce(lambda a, b: a + b)


def forest_importances(rows: Binned, features: list[int], trees: int, depth: int, seed: int) -> np.ndarray:
    """``featureImportances`` of a random forest of two or more classes over some of the features: ``trees`` bootstrap samples, the root of
    their number of features tried at each node, Gini impurity.  All trees grow by one level in a pass."""
    n_sub = math.ceil(math.sqrt(len(features))) if trees > 1 else len(features)
    rng = np.random.default_rng([seed, len(features)])
    grown, todo = [Tree() for _ in range(trees)], {}
    for t in range(trees):
        grown[t].add(None)
        todo[t] = [0]
    for _ in range(depth):
        tried = {(t, v): np.sort(rng.choice(features, n_sub, replace=False)) for t in todo for v in todo[t]}
        if not tried:
            break
        counts = _summed(rows.blocks, _class_counts([(t, grown[t].shape(), {v: tried[t, v] for v in todo[t]}) for t in todo], n_sub, rows.n_classes))
        after = {}
        for (t, v), h in zip(tried, counts):
            found = gini_split(h)
            grown[t].stats[v] = h[0].sum(axis=0)
            if found is not None:
                j, cut, gain, low, high = found
                for child, s in zip(grown[t].split(v, int(tried[t, v][j]), cut, gain, low, high), (low, high)):
                    if (s > 0).sum() > 1:
                        after.setdefault(t, []).append(child)
        todo = after
    place = {f: k for k, f in enumerate(features)}
    total = np.zeros(len(features))
    for tree in grown:
        w = np.zeros(len(features))
        _add_gains(tree, 0, place, w)
        total += w / w.sum() if w.sum() > 0 else 0.0
    return total / total.sum() if total.sum() > 0 else total


def _class_counts(jobs, n_sub, n_classes):
    walk, width = _rows_in_nodes(), BINS * n_classes
    n_nodes = sum(len(nodes) for _, _, nodes in jobs)

    def f(bins, label, bags):
        out = np.zeros((n_nodes, n_sub, BINS, n_classes), np.int64)
        y, at = label.astype(np.int64), 0
        offset = (np.arange(n_sub) * width)[:, None]
        for t, shape, nodes in jobs:
            order = {v: at + k for k, v in enumerate(nodes)}
            at += len(nodes)
            for node, r in walk(shape, bins, np.repeat(np.arange(len(y)), bags[t])):
                if node in order and len(r):
                    cells = bins[nodes[node]].take(r, axis=1) * np.int64(n_classes) + (y.take(r) + offset)
                    out[order[node]] = np.bincount(cells.ravel(), minlength=n_sub * width).reshape(n_sub, BINS, n_classes)
        return out

    return f


def gini_split(h: np.ndarray):
    """Best (feature, last bin on the left, gain, left and right class counts) of counts by feature, bin and class, or None."""
    low = h.cumsum(axis=1)[:, :-1].astype(float)
    total = h[0].sum(axis=0).astype(float)
    high = total - low
    nl, nr, n = low.sum(axis=2), high.sum(axis=2), total.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = ((low * low).sum(axis=2) / nl + (high * high).sum(axis=2) / nr) / n - (total * total).sum() / (n * n)
    gain = np.where((nl > 0) & (nr > 0), gain, -1.0)
    j, cut = np.unravel_index(gain.argmax(), gain.shape)
    if gain[j, cut] <= 1e-14:
        return None
    return int(j), int(cut), float(gain[j, cut]), low[j, cut], high[j, cut]


def _add_gains(tree: Tree, node: int, place: dict, w: np.ndarray):
    """Adds gain times rows of the splits below; the class where the subtree says one only: MLlib merges such leaves."""
    if tree.feature[node] < 0:
        return int(np.argmax(tree.stats[node]))
    a = _add_gains(tree, tree.left[node], place, w)
    b = _add_gains(tree, tree.left[node] + 1, place, w)
    if a is not None and a == b:
        return a
    w[place[tree.feature[node]]] += tree.gain[node] * tree.stats[node].sum()
    return None
