"""Cross-validated trees of several depths from one fit (H2, H3).

A tree grows level by level and a node's split does not depend on the depth limit, so the tree of a smaller ``max_depth``
is the upper part of a deeper one, with each cut node predicting the class of its own rows. Spark merges sibling leaves
of one class after the fit; a node above them predicts that class too, so the cut predicts the same. One fit for every
(fold, other parameters) serves all depths, and one pass over the table scores every row under all trees and keeps only
counts by (combination, fold, side, class, predicted class). In large tables the trees of all folds grow together
(``grown_trees``), whose counts hold the scores already.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import bounded
from ..sources.scratch import scratch
from . import grown_trees as G
from .fold_stats import MAX_COUNTS, PAIR_COUNTS, counted, matrix, pair_rows
from .models import catalogue as M

BATCH_ROWS = 65_536         # rows walked through the trees at once


@dataclass
class TreeTable:
    """Nodes of a tree as arrays; a leaf is its own child. ``categories`` has the left side of splits by category."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    prediction: np.ndarray
    categories: dict[int, np.ndarray]

    @staticmethod
    def of(spark: SparkSession, model) -> TreeTable:
        """From the saved model's node table (at most 2^(depth + 1) rows)."""
        path = scratch(spark, "tree")
        model.write().save(path)
        nodes = sorted(spark.read.parquet(f"{path}/data").collect(), key=lambda r: r["id"])
        at = {r["id"]: i for i, r in enumerate(nodes)}
        n = len(nodes)
        t = TreeTable(np.zeros(n, dtype=int), np.full(n, np.inf), np.arange(n), np.arange(n),
                      np.array([r["prediction"] for r in nodes]), {})
        for i, r in enumerate(nodes):
            if r["leftChild"] < 0:
                continue
            split = r["split"]
            t.feature[i], t.left[i], t.right[i] = split["featureIndex"], at[r["leftChild"]], at[r["rightChild"]]
            if split["numCategories"] < 0:
                t.threshold[i] = split["leftCategoriesOrThreshold"][0]
            else:
                t.categories[i] = np.array(split["leftCategoriesOrThreshold"])
        return t

    def by_depth(self, x: np.ndarray, depths: set[int]) -> dict[int, np.ndarray]:
        """Predicted class of each row when the tree is cut at each of ``depths``."""
        at, rows, out = np.zeros(len(x), dtype=int), np.arange(len(x)), {}
        for level in range(max(depths) + 1):
            if level in depths:
                out[level] = self.prediction[at]
            value = x[rows, self.feature[at]]
            goes_left = value <= self.threshold[at]
            for node, kept in self.categories.items():
                here = at == node
                goes_left[here] = np.isin(value[here], kept)
            at = np.where(goes_left, self.left[at], self.right[at])
        return out


def tree_counts(name: str, data: DataFrame, combos: list[dict], counts: list[dict],
                parallelism: int = 4) -> list[tuple[int, int, bool, float, float, int]]:
    """(combination, fold, on the test side, class, predicted class, rows). ``counts`` are the class counts of each
    fold's training side; ``combos`` have max_depth."""
    groups: dict[tuple, list[tuple[int, int]]] = {}
    for i, c in enumerate(combos):
        depth = int({**M.CATALOGUE[name].defaults, **c}["max_depth"] or M.MAX_DEPTH)
        groups.setdefault(tuple(sorted((k, v) for k, v in c.items() if k != "max_depth")), []).append((i, depth))
    jobs = [(g, f) for g in groups for f in range(len(counts))]
    if all({k for k, _ in g} <= {"min_samples_leaf"} for g in groups) and all(G.fits(data, c) for c in counts):
        defaults = M.CATALOGUE[name].defaults
        return G.fold_counts(data, [(f, max(d for _, d in groups[g]), int((defaults | dict(g)).get("min_samples_leaf", 1)), groups[g])
                                    for g, f in jobs], counts)

    def fitted(job: tuple[tuple, int]) -> tuple[int, list[tuple[int, int]], TreeTable]:
        group, fold = job
        params = dict(group) | {"max_depth": max(d for _, d in groups[group])}
        side = data.where(F.col("fold") != fold).drop("fold")
        return fold, groups[group], TreeTable.of(
            data.sparkSession, M.train_one(name, side, params, counts=counts[fold]).model)

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        trees = list(pool.map(fitted, jobs))
    classes = np.unique(np.concatenate([[c for side in counts for c in side], *[t.prediction for _, _, t in trees]]).astype(float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for s in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(s, BATCH_ROWS)
                x, y, at = matrix(part.column("x")), part.column("y").to_numpy(), part.column("fold").to_numpy()
                truth = np.searchsorted(classes, y)
                for fold, members, tree in trees:
                    found = tree.by_depth(x, {d for _, d in members})
                    for i, depth in members:
                        pairs = counted(truth, np.searchsorted(classes, found[depth]), at == fold, len(classes))
                        total[i, fold] = total.get((i, fold), 0) + pairs
        yield from pair_rows(total, classes)

    rows = data.select(vector_to_array(F.col("features")).alias("x"), F.col("label").cast("double").alias("y"), "fold")
    sums = rows.mapInArrow(run, PAIR_COUNTS).groupBy("combo", "fold", "test", "y", "p").agg(F.sum("n").alias("n"))
    return [tuple(r) for r in bounded(sums, "classes x classes x models", MAX_COUNTS)]
