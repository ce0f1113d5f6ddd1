"""Classification trees of large tables, many grown together from counts (M3, M5, M7, H2, H3).

Spark's own fit keeps every row as an object with its bag sizes and sends it through every tree from the root at each
level. Here the table is kept once as chunks of bytes (bin of every feature, class, fold), and one pass per level counts
(node, feature, bin, class) for all trees with numpy. Counts of a node are added up in one task, which also picks its
split, so only splits reach the driver.

The trees are those of Spark's fit: at most 32 bins of a feature from a sample of 10,000 rows, weighted gini impurity,
``minInstancesPerNode`` on row counts, sibling leaves of one class merged in models. A forest draws a Poisson(1) bag for
every (tree, row) and ceil(sqrt(features)) features for every (tree, node), from its seed; its draws are not Spark's.
"""

from __future__ import annotations

import hashlib
import json
import math
import pickle
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import (DecisionTreeClassificationModel, DecisionTreeClassifier, RandomForestClassificationModel,
                                       RandomForestClassifier)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bounded
from ..session import cut_lineage
from ..sources.scratch import scratch
from .fold_stats import matrix

BINS = 32
CANDIDATE_ROWS = 10_000     # sampled for the thresholds
CHUNK_ROWS = 1 << 17
PART_BYTES = 128 << 20      # chunks of a task at most, about
CELLS = 12_000_000          # counts a task holds at once: 96 MB
MAX_CLASSES = 64
GROWN_ROWS = 200_000        # smaller tables are left to Spark's fits
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(9)])
BAG = np.searchsorted(_POISSON, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)   # a 16-bit draw's bag size


def binary_features(data: DataFrame, features: str = "features") -> set[int] | None:
    """Features that are categories of two values, 0 and 1; None if some have more."""
    attrs = data.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
    if any(len(a.get("vals", [])) != 2 for a in attrs.get("nominal", [])):
        return None
    return {a["idx"] for kind in ("binary", "nominal") for a in attrs.get(kind, [])}


def fits(data: DataFrame, counts: dict) -> bool:
    """Whether ``data`` is for this module: large, with few classes and no category of many values."""
    return (sum(counts.values()) > GROWN_ROWS and 2 <= len(counts) <= MAX_CLASSES and None not in counts
            and binary_features(data) is not None)


def thresholds(values: np.ndarray, weight: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Candidate thresholds of a feature, as Spark picks them from weighted values."""
    distinct, at = np.unique(values, return_inverse=True)
    n = np.bincount(at, weights=weight, minlength=len(distinct))
    middle = (distinct[:-1] + distinct[1:]) / 2
    if len(middle) <= bins - 1:
        return middle
    stride = n.sum() / bins
    out, reached, target = [], n[0], stride
    for i in range(1, len(n)):
        before, reached = reached, reached + n[i]
        if abs(before - target) < abs(reached - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out)


@dataclass
class Level:
    """Nodes of one level: feature (-1: a leaf), last bin of the left side, children's numbers in the next level (two a
    node), rows by class, gain."""
    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    counts: np.ndarray
    gain: np.ndarray


@dataclass
class Tree:
    """A tree to grow: ``side`` picks the thresholds, ``fold`` is left out (None: no fold is), ``bag`` is the number of a
    forest's tree (None: every row counts once)."""
    side: int
    fold: int | None
    bag: int | None
    max_depth: int
    min_rows: int
    weight: np.ndarray                  # of each class
    subset: int | None = None           # features a node may use (None: all)
    seed: int = 0
    levels: list[Level] = field(default_factory=list)
    open: np.ndarray = field(default_factory=lambda: np.ones(1, dtype=bool))
    signature: str = ""

    def counts_key(self) -> tuple:
        """Trees of one key have the same counts."""
        return self.side, self.fold, self.bag, self.subset, self.signature

    def features(self, d: int) -> np.ndarray | None:
        """Features of each open node of the pending level."""
        if self.subset is None or self.subset >= d:
            return None
        rng = np.random.default_rng([self.seed, self.bag or 0, len(self.levels)])
        return np.sort(rng.random((int(self.open.sum()), d)).argsort(axis=1)[:, :self.subset], axis=1)

    def take(self, feature: np.ndarray, cut: np.ndarray, gain: np.ndarray, left: np.ndarray, total: np.ndarray) -> None:
        """Splits of the open nodes; their children are the next pending level."""
        n, k = len(self.open), total.shape[1]
        at = np.flatnonzero(self.open)
        level = Level(np.full(n, -1), np.zeros(n, dtype=np.uint8), np.zeros(2 * n, dtype=np.intp),
                      self.children if self.levels else total.copy(), np.full(n, -1.0))
        level.feature[at], level.cut[at], level.gain[at] = feature, cut, np.where(feature >= 0, gain, -1.0)
        split = feature >= 0
        numbers = 2 * np.arange(int(split.sum()))
        level.child[2 * at[split]], level.child[2 * at[split] + 1] = numbers, numbers + 1
        self.children = np.stack([left[split], total[split] - left[split]], axis=1).reshape(-1, k)
        self.levels.append(level)
        last = len(self.levels) == self.max_depth
        self.open = np.zeros(len(self.children), dtype=bool) if last else gini(self.children * self.weight) >= np.finfo(float).eps
        self.signature = hashlib.md5((self.signature + "|").encode() + level.feature.tobytes() + level.cut.tobytes()
                                     + self.open.tobytes()).hexdigest()

    def close(self) -> None:
        """The pending nodes are leaves."""
        n = len(self.open)
        if n:
            self.levels.append(Level(np.full(n, -1), np.zeros(n, dtype=np.uint8), np.zeros(2 * n, dtype=np.intp),
                                     self.children, np.full(n, -1.0)))


def gini(counts: np.ndarray) -> np.ndarray:
    """1 - sum of squared shares along the last axis; 0 without rows."""
    total = counts.sum(axis=-1)
    safe = np.where(total > 0, total, 1.0)
    out = np.ones(total.shape)
    for c in range(counts.shape[-1]):
        share = counts[..., c] / safe
        out -= share * share
    return np.where(total > 0, out, 0.0)


def best_splits(counts: np.ndarray, cuts: np.ndarray, weight: np.ndarray, min_rows: int):
    """(feature place or -1, cut, gain, rows left, rows) of each node; ``counts`` by (node, feature place, bin, class),
    ``cuts`` thresholds of each (node, feature place). The first of equal gains wins."""
    total = counts[:, 0].sum(axis=1)
    if counts.shape[2] < 2:
        return np.full(len(counts), -1), np.zeros(len(counts), dtype=int), np.zeros(len(counts)), total * 0.0, total
    left = counts[:, :, :-1].cumsum(axis=2)
    rows_left, rows = left.sum(axis=-1), total.sum(axis=-1)
    allowed = (np.arange(left.shape[2]) < cuts[:, :, None]) & (rows_left >= min_rows) & (
        rows[:, None, None] - rows_left >= min_rows)
    whole = total * weight
    weighed = left * weight
    other = whole[:, None, None, :] - weighed
    size = np.where(rows > 0, whole.sum(axis=-1), 1.0)[:, None, None]
    gain = gini(whole)[:, None, None] - weighed.sum(axis=-1) / size * gini(weighed) - other.sum(axis=-1) / size * gini(other)
    gain = np.where(allowed, gain, -np.inf).reshape(len(counts), -1)
    best = gain.argmax(axis=1)
    at = np.arange(len(counts))
    place, cut = best // left.shape[2], best % left.shape[2]
    return np.where(gain[at, best] > 0, place, -1), cut, gain[at, best], left[at, place, cut], total


@dataclass
class Chunks:
    """The table as chunks of bytes, the thresholds of every side and feature, and the class values."""
    frame: DataFrame
    sides: list[list[np.ndarray]]
    classes: np.ndarray

    @staticmethod
    def of(data: DataFrame, class_counts: list[dict], folds: bool, features: str = "features", label: str = "label") -> Chunks:
        """``class_counts`` are those of each side; with ``folds`` side f is the rows outside fold f."""
        classes = np.array(sorted({float(c) for side in class_counts for c in side}))
        values = data.select(vector_to_array(F.col(features)).alias("x"), F.col(label).cast("double").alias("y"),
                             (F.col("fold") if folds else F.lit(0)).cast("int").alias("fold"))
        binary = binary_features(data, features)
        share = CANDIDATE_ROWS / min(sum(side.values()) for side in class_counts)
        sample = bounded(values if share >= 1 else values.sample(False, share, 42), "rows for thresholds", 10 * CANDIDATE_ROWS)
        x, y, at = np.array([r["x"] for r in sample]), np.array([r["y"] for r in sample]), np.array([r["fold"] for r in sample])
        sides = []
        for f, counts in enumerate(class_counts):
            mine = at != f if folds else np.ones(len(y), dtype=bool)
            weight = class_weights(counts, classes)[np.searchsorted(classes, y[mine])]
            sides.append([np.array([0.5]) if j in binary else thresholds(x[mine, j], weight) for j in range(x.shape[1])])

        width = len(sides) * x.shape[1] + 2
        chunk_rows = min(CHUNK_ROWS, max(1024, PART_BYTES // (8 * width)))

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, number, held, size = TaskContext.get().partitionId() << 32, 0, [], 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                found = matrix(batch.column("x"))
                if batch.column("y").null_count or not np.isfinite(found).all():
                    raise ValueError("features and labels must be finite numbers")
                place = np.searchsorted(classes, batch.column("y").to_numpy()).astype(np.uint8)
                found = np.ascontiguousarray(found.T)
                held.append((np.stack([(found[j] > cuts[0]).astype(np.uint8) if len(cuts) == 1
                                       else np.searchsorted(cuts, found[j]).astype(np.uint8)
                                       for side in sides for j, cuts in enumerate(side)]), place, batch.column("fold").to_numpy().astype(np.uint8)))
                size += batch.num_rows
                if size >= chunk_rows:
                    yield joined(part + number, held)
                    number, held, size = number + 1, [], 0
            if held:
                yield joined(part + number, held)

        def joined(chunk: int, held: list) -> pa.RecordBatch:
            bins, place, fold = (np.concatenate(p, axis=-1) for p in zip(*held))
            return pa.RecordBatch.from_pydict({
                "at": pa.array([chunk], pa.int64()), "bins": pa.array([bins.tobytes()], pa.binary()),
                "y": pa.array([place.tobytes()], pa.binary()), "fold": pa.array([fold.tobytes()], pa.binary())})

        rows = sum(class_counts[0].values()) * (2 if folds else 1)
        parts = max(2 * data.sparkSession.sparkContext.defaultParallelism, math.ceil(rows * width / PART_BYTES))
        frame = values.coalesce(parts).mapInArrow(packed, "at long, bins binary, y binary, fold binary")
        return Chunks(cut_lineage(frame), sides, classes)


def class_weights(counts: dict, classes: np.ndarray) -> np.ndarray:
    """n / (k * n_c) of each class; 0 for one that is absent."""
    n, k = sum(counts.values()), len(counts)
    known = {float(c): n / (k * v) for c, v in counts.items() if v}
    return np.array([known.get(float(c), 0.0) for c in classes])


def walked(levels: list[Level], flat: np.ndarray, n: int, rows: np.ndarray, more: np.ndarray | None):
    """(node, row, more) of the rows that reach the level after ``levels``; ``flat`` are the bins of n rows."""
    node = np.zeros(len(rows), dtype=np.intp)
    for level in levels:
        ends = bool((level.feature < 0).any())
        if ends:
            on = np.flatnonzero(level.feature.take(node) >= 0)
            node, rows = node.take(on), rows.take(on)
            more = None if more is None else more.take(on)
        at = (level.feature * n).take(node)
        at += rows
        right = flat.take(at) > level.cut.take(node)
        node *= 2
        node += right
        if ends:    # else children have their numbers in order
            node = level.child.take(node)
    return node, rows, more


@dataclass
class _Unit:
    """Open nodes [lo, hi) of the trees of one counts key."""
    trees: list[Tree]
    lo: int
    hi: int
    slot: np.ndarray                 # place of each pending node, -1 if it is not counted
    features: np.ndarray | None      # of each place


def _units(trees: list[Tree], d: int, k: int) -> Iterator[list[_Unit]]:
    """The counting of a level, in batches of at most CELLS counts."""
    shared: dict[tuple, list[Tree]] = {}
    for t in trees:
        shared.setdefault(t.counts_key(), []).append(t)
    batch, room = [], CELLS
    for members in shared.values():
        first = members[0]
        nodes = np.flatnonzero(first.open)
        chosen = first.features(d)
        size = (d if chosen is None else chosen.shape[1]) * BINS * k
        step = max(1, CELLS // size)
        for lo in range(0, len(nodes), step):
            hi = min(lo + step, len(nodes))
            if batch and (hi - lo) * size > room:
                yield batch
                batch, room = [], CELLS
            slot = np.full(len(first.open), -1, dtype=np.intp)
            slot[nodes[lo:hi]] = np.arange(hi - lo)
            batch.append(_Unit(members, lo, hi, slot, None if chosen is None else chosen[lo:hi]))
            room -= (hi - lo) * size
    if batch:
        yield batch


def _opened(row, d: int, k: int):
    """(bins by side as flat arrays, class, fold, rows) of a chunk."""
    y = np.frombuffer(row["y"], dtype=np.uint8)
    n = len(y)
    bins = np.frombuffer(row["bins"], dtype=np.uint8).reshape(-1, d * n)
    return bins, y.astype(np.intp), np.frombuffer(row["fold"], dtype=np.uint8), n


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


def _bag(tree: Tree, chunk: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the tree's bag, and how often each is."""
    bits = np.random.SFC64([tree.seed, tree.bag, chunk >> 32, chunk & 0xFFFFFFFF]).random_raw(n // 4 + 1)
    often = BAG.take(bits.view(np.uint16)[:n])
    rows = np.flatnonzero(often != 0)
    return rows, often.take(rows).astype(float)


def _counted(chunks: Chunks, units: list[_Unit]) -> dict[int, list[tuple]]:
    """Splits of the units' nodes for every tree, from one pass."""
    k, d, sides = len(chunks.classes), len(chunks.sides[0]), chunks.sides

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for row in _chunk_rows(batches):
            bins, y, fold, n = _opened(row, d, k)
            outside: dict[int | None, np.ndarray] = {None: np.arange(n)}
            codes: dict[int, np.ndarray] = {}   # bin and class of every feature and row
            for u, unit in enumerate(units):
                t = unit.trees[0]
                if t.bag is not None:
                    rows, often = _bag(t, row["at"], n)
                else:
                    if t.fold not in outside:
                        outside[t.fold] = np.flatnonzero(fold != t.fold)
                    rows, often = outside[t.fold], None
                flat = bins[t.side]
                node, rows, often = walked(t.levels, flat, n, rows, often)
                if (unit.slot < 0).any():
                    node = unit.slot.take(node)
                    on = np.flatnonzero(node >= 0)
                    node, rows, often = node.take(on), rows.take(on), None if often is None else often.take(on)
                m = d if unit.features is None else unit.features.shape[1]
                found = total.setdefault(u, np.zeros((m, (unit.hi - unit.lo) * BINS * k)))
                if t.side not in codes:
                    small = np.uint8 if BINS * k <= 256 else np.uint16
                    codes[t.side] = (flat.reshape(d, n) * small(k) + y.astype(small)).reshape(-1)
                first = node * (BINS * k)
                for j in range(m):
                    at = rows + j * n if unit.features is None else (unit.features[:, j] * n).take(node) + rows
                    code = first + codes[t.side].take(at)
                    if often is None:
                        found[j] += np.bincount(code, minlength=found.shape[1])
                    else:
                        np.add.at(found[j], code, often)
        for u, found in total.items():
            yield pa.RecordBatch.from_pydict({"unit": pa.array([u], pa.int32()),
                                              "counts": pa.array([found.astype(np.uint32).tobytes()], pa.binary())})

    def split(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        unit = units[int(key[0])]
        counts = sum(np.frombuffer(c, dtype=np.uint32).astype(float) for c in rows["counts"])
        m = d if unit.features is None else unit.features.shape[1]
        counts = counts.reshape(m, unit.hi - unit.lo, BINS, k).swapaxes(0, 1)
        chosen = np.broadcast_to(np.arange(d), (len(counts), d)) if unit.features is None else unit.features
        cuts = np.array([len(c) for c in sides[unit.trees[0].side]])[chosen]
        out = []
        for t in unit.trees:
            at, cut, gain, left, total = best_splits(counts, cuts, t.weight, t.min_rows)
            out.append((np.where(at >= 0, chosen[np.arange(len(at)), at], -1), cut, gain, left, total))
        return pd.DataFrame({"unit": [key[0]], "splits": [pickle.dumps(out)]})

    sums = chunks.frame.mapInArrow(count, "unit int, counts binary").groupBy("unit").applyInPandas(split, "unit int, splits binary")
    return {r["unit"]: pickle.loads(r["splits"]) for r in bounded(sums, "units of a level")}


def grow(chunks: Chunks, trees: list[Tree]) -> None:
    """Grows ``trees`` level by level."""
    d, k = len(chunks.sides[0]), len(chunks.classes)
    while active := [t for t in trees if t.open.any() and len(t.levels) < t.max_depth]:
        found: dict[int, list[tuple]] = {id(t): [] for t in active}
        for units in _units(active, d, k):
            splits = _counted(chunks, units)
            for u, unit in enumerate(units):
                for i, t in enumerate(unit.trees):
                    nodes = unit.hi - unit.lo
                    # a node of no row at all is in no task's counts
                    none = np.full(nodes, -1), np.zeros(nodes, dtype=int), np.zeros(nodes), np.zeros((nodes, k)), np.zeros((nodes, k))
                    found[id(t)].append(splits[u][i] if u in splits else none)
        for t in active:
            t.take(*(np.concatenate(p) for p in zip(*found[id(t)])))
    for t in trees:
        t.close()


def fold_counts(data: DataFrame, specs: list[tuple[int, int, int, list[tuple[int, int]]]], counts: list[dict]) -> list[tuple]:
    """(combination, fold, on the test side, class, predicted class, rows). ``specs`` are (fold, largest depth, least rows
    of a node, (combination, depth) pairs), ``counts`` the class counts outside each fold."""
    chunks = Chunks.of(data, counts, folds=True)
    classes, d = chunks.classes, len(chunks.sides[0])
    k = len(classes)
    trees = [Tree(fold, fold, None, depth, least, class_weights(counts[fold], classes)) for fold, depth, least, _ in specs]
    grow(chunks, trees)
    alike: dict[tuple, int] = {}
    number = [alike.setdefault((t.fold, t.signature), i) for i, t in enumerate(trees)]   # the first of equal trees

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for row in _chunk_rows(batches):
            bins, y, fold, n = _opened(row, d, k)
            for i in alike.values():
                t = trees[i]
                flat, rows, node = bins[t.side], np.flatnonzero(fold == t.fold), None
                node = np.zeros(len(rows), dtype=np.intp)
                for at, level in enumerate(t.levels):
                    found = np.bincount(node * k + y.take(rows), minlength=len(level.feature) * k)
                    total[i, at] = total.get((i, at), 0) + found
                    node, rows, _ = _stepped(level, flat, n, node, rows)
        for (i, at), found in total.items():
            yield pa.RecordBatch.from_pydict({"tree": pa.array([i], pa.int32()), "level": pa.array([at], pa.int32()),
                                              "counts": pa.array([found.astype(np.int64).tobytes()], pa.binary())})

    def added(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        counts = sum(np.frombuffer(c, dtype=np.int64) for c in rows["counts"])
        return pd.DataFrame({"tree": [key[0]], "level": [key[1]], "counts": [counts.tobytes()]})

    schema = "tree int, level int, counts binary"
    tested = {(r["tree"], r["level"]): np.frombuffer(r["counts"], dtype=np.int64).reshape(-1, k) for r in bounded(
        chunks.frame.mapInArrow(count, schema).groupBy("tree", "level").applyInPandas(added, schema), "levels of trees")}
    out = []
    for (fold, _, _, members), tree, first in zip(specs, trees, number):
        for combo, depth in members:
            pairs = {True: np.zeros((k, k), dtype=np.int64), False: np.zeros((k, k), dtype=np.int64)}
            for at, level in enumerate(tree.levels[:depth + 1]):
                ends = (level.feature < 0) | (at == depth)
                said = (level.counts * tree.weight).argmax(axis=1)[ends]
                for side, seen in ((True, tested.get((first, at))), (False, level.counts)):
                    if seen is not None:
                        np.add.at(pairs[side].T, said, seen[ends].astype(np.int64))
            out += [(combo, fold, side, float(classes[y]), float(classes[p]), int(found[y, p]))
                    for side, found in pairs.items() for y, p in zip(*np.nonzero(found))]
    return out


def _stepped(level: Level, flat: np.ndarray, n: int, node: np.ndarray, rows: np.ndarray):
    """(node, row, nothing) of the rows that go on to the next level."""
    on = np.flatnonzero(level.feature.take(node) >= 0)
    node, rows = node.take(on), rows.take(on)
    right = flat.take((level.feature * n).take(node) + rows) > level.cut.take(node)
    return level.child.take(2 * node + right), rows, None


def forest(est: RandomForestClassifier, data: DataFrame, counts: dict) -> RandomForestClassificationModel:
    """The forest of ``est`` on ``data``, whose classes have balanced weights; ``counts`` are its class counts."""
    chunks = Chunks.of(data, [counts], folds=False)
    weight = class_weights(counts, chunks.classes)
    subset = math.ceil(math.sqrt(len(chunks.sides[0])))
    trees = [Tree(0, None, i, est.getMaxDepth(), est.getMinInstancesPerNode(), weight, subset, est.getSeed())
             for i in range(est.getNumTrees())]
    grow(chunks, trees)
    return as_model(est, trees, chunks, binary_features(data))


def single(est: DecisionTreeClassifier, data: DataFrame, counts: dict) -> DecisionTreeClassificationModel:
    """The tree of ``est`` (gini impurity) on ``data``, as ``forest``."""
    chunks = Chunks.of(data, [counts], folds=False)
    tree = Tree(0, None, None, est.getMaxDepth(), est.getMinInstancesPerNode(), class_weights(counts, chunks.classes))
    grow(chunks, [tree])
    return as_model(est, [tree], chunks, binary_features(data))


def _nodes(tree: Tree, number: int, chunks: Chunks, binary: set[int], n_classes: int) -> list[tuple]:
    """Rows of Spark's node table of a tree: parents before children, sibling leaves of one class merged."""
    said = [(lv.counts * tree.weight).argmax(axis=1) for lv in tree.levels]
    leaf = [lv.feature < 0 for lv in tree.levels]
    for at in range(len(tree.levels) - 2, -1, -1):
        pair = tree.levels[at].child.reshape(-1, 2)
        same = leaf[at + 1][pair].all(axis=1) & (said[at + 1][pair[:, 0]] == said[at + 1][pair[:, 1]])
        both = ~leaf[at] & same
        for node in np.flatnonzero(both):     # the merged node predicts what its children do
            said[at][node] = said[at + 1][pair[node, 0]]
        leaf[at] = leaf[at] | both
    place = chunks.classes.astype(int)
    rows, here, ids = [], [0], 1
    for at, level in enumerate(tree.levels):
        weighed, impurity, below = level.counts * tree.weight, gini(level.counts * tree.weight), []
        first = len(rows)
        for i, node in enumerate(here):
            stats = np.zeros(n_classes)
            stats[place] = weighed[node]
            fixed = (float(place[said[at][node]]), float(impurity[node]), stats.tolist(), int(level.counts[node].sum()))
            if leaf[at][node]:
                rows.append((number, (first + i, *fixed, -1.0, -1, -1, (-1, [], -1))))
                continue
            j = int(level.feature[node])
            split = (j, [0.0], 2) if j in binary else (j, [float(chunks.sides[tree.side][j][level.cut[node]])], -1)
            rows.append((number, (first + i, *fixed, float(level.gain[node]), ids, ids + 1, split)))
            below += level.child[2 * node:2 * node + 2].tolist()
            ids += 2
        here = below
    return rows


_NODE = ("id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,gain:double,leftChild:int,"
         "rightChild:int,split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>")


def as_model(est: DecisionTreeClassifier | RandomForestClassifier, trees: list[Tree], chunks: Chunks,
             binary: set[int]) -> DecisionTreeClassificationModel | RandomForestClassificationModel:
    """Spark's own model of the trees, by way of its saved form."""
    spark = chunks.frame.sparkSession
    path = scratch(spark, "forest")
    n_classes = int(chunks.classes.max()) + 1
    own = {p.name: v for p, v in est._paramMap.items()}
    defaults = {p.name: v for p, v in est._defaultParamMap.items() if isinstance(v, int | float | str | bool)}
    about = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version}
    shape = {"numFeatures": len(chunks.sides[0]), "numClasses": n_classes}
    nodes = [r for i, t in enumerate(trees) for r in _nodes(t, i, chunks, binary, n_classes)]
    kind = "org.apache.spark.ml.classification.{}ClassificationModel".format
    whole = about | shape | {"uid": est.uid, "paramMap": own, "defaultParamMap": defaults}
    if isinstance(est, DecisionTreeClassifier):
        whole["class"] = kind("DecisionTree")
        spark.createDataFrame([r for _, r in nodes], _NODE).write.parquet(f"{path}/data")
    else:
        whole |= {"class": kind("RandomForest"), "numTrees": len(trees)}
        of_forest = ("numTrees", "featureSubsetStrategy", "subsamplingRate", "bootstrap")
        shared = about | {"class": kind("DecisionTree")} | {name: {n: v for n, v in given.items() if n not in of_forest}
                                                            for name, given in (("paramMap", own), ("defaultParamMap", defaults))}
        each = [(i, json.dumps(shared | {"uid": f"dtc_{est.uid[-8:]}_{i}"}), 1.0) for i in range(len(trees))]
        spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
        spark.createDataFrame(nodes, f"treeID int, nodeData struct<{_NODE}>").write.parquet(f"{path}/data")
    spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    if isinstance(est, DecisionTreeClassifier):
        return DecisionTreeClassificationModel.load(path)
    model = RandomForestClassificationModel.load(path)
    model.scorer = Scorer.of(nodes, len(trees), max(len(t.levels) for t in trees) - 1)
    return model


@dataclass
class Scorer:
    """A forest's nodes as arrays over all trees; a leaf is its own child and has its classes' shares."""
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    share: np.ndarray
    depth: int

    @staticmethod
    def of(nodes: list[tuple], n_trees: int, depth: int) -> Scorer:
        sizes = np.bincount([t for t, _ in nodes], minlength=n_trees)
        roots = np.cumsum(sizes) - sizes
        at = np.arange(len(nodes))
        child = np.stack([at, at], axis=1)
        feature, threshold, share = np.zeros(len(nodes), dtype=np.intp), np.full(len(nodes), np.inf), []
        for i, (tree, (_, _, _, stats, _, _, left, right, (j, values, kinds))) in enumerate(nodes):
            share.append(np.array(stats) / (sum(stats) or 1.0))
            if left >= 0:
                child[i] = roots[tree] + left, roots[tree] + right
                feature[i], threshold[i] = j, values[0] + (0.5 if kinds > 0 else 0.0)
        return Scorer(roots, feature, threshold, child.reshape(-1), np.array(share), depth)

    def votes(self, x: np.ndarray) -> np.ndarray:
        """Sum of the class shares of all trees for each row."""
        n, d = x.shape
        flat, rows, out = np.ascontiguousarray(x).reshape(-1), np.arange(n) * d, np.zeros((n, self.share.shape[1]))
        for root in self.roots:
            node = np.full(n, root)
            for _ in range(self.depth):
                right = flat.take(self.feature.take(node) + rows) > self.threshold.take(node)
                node *= 2
                node += right
                node = self.child.take(node)
            out += self.share.take(node, axis=0)
        return out


def scored(model: RandomForestClassificationModel, scorer: Scorer, df: DataFrame) -> DataFrame:
    """What ``model.transform`` adds, with trees walked for a batch of rows at a time."""
    @F.arrow_udf("array<double>")
    def votes(x: pa.Array) -> pa.Array:
        if not len(x):
            return pa.array([], pa.list_(pa.float64()))
        found = scorer.votes(matrix(x))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32()), pa.array(found.reshape(-1)))

    raw = F.col("_votes")
    total = F.aggregate(raw, F.lit(0.0), lambda a, v: a + v)
    return (df.withColumn("_votes", votes(vector_to_array(F.col(model.getFeaturesCol()))))
            .withColumn(model.getRawPredictionCol(), array_to_vector(raw))
            .withColumn(model.getProbabilityCol(), array_to_vector(F.transform(raw, lambda v: v / total)))
            .withColumn(model.getPredictionCol(), (F.array_position(raw, F.array_max(raw)) - 1).cast("double")).drop("_votes"))
