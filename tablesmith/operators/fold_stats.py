"""Cross-validated naive Bayes from one table of fold statistics (H2, H3).

Count, mean and squared deviations of a feature add up over disjoint parts. So one
aggregate by (fold, class) holds all that any naive Bayes fit of a k-fold search needs:
the training side of fold f is the merge of the other folds' rows, whatever the
smoothing. A second pass scores every row under all (combination, fold) models
at once and keeps only counts by (combination, fold, side, class, predicted class).
The table is read twice in all, however many combinations there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bounded

MAX_COUNTS = 1_000_000
PAIR_COUNTS = "combo int, fold int, test boolean, y double, p double, n long"
SCORE_CELLS = 500_000     # class scores held at once while a batch is scored


@dataclass
class Moments:
    """Row count, means and sums of squared deviations of the features."""
    n: int
    mean: np.ndarray
    dev: np.ndarray

    def merged(self, other: Moments) -> Moments:
        n = self.n + other.n
        gap = other.mean - self.mean
        return Moments(n, self.mean + gap * (other.n / n), self.dev + other.dev + gap * gap * (self.n * other.n / n))


def fold_moments(data: DataFrame, features: str = "features", label: str = "label") -> dict[tuple[int, float], Moments]:
    """(fold, class) -> Moments, from one aggregate."""
    stats = Summarizer.metrics("count", "mean", "variance").summary(F.col(features)).alias("s")
    out = {}
    for r in bounded(data.groupBy("fold", F.col(label).cast("double").alias("y")).agg(stats), "classes x folds"):
        n = r["s"]["count"]
        # the summary has the sample variance
        out[r["fold"], r["y"]] = Moments(n, np.array(r["s"]["mean"].toArray()), np.array(r["s"]["variance"].toArray()) * max(n - 1, 0))
    return out


def _merge(parts: list[Moments]) -> Moments:
    total = parts[0]
    for p in parts[1:]:
        total = total.merged(p)
    return total


@dataclass
class FoldModel:
    """Naive Bayes of one training side: class values, log priors, means, variances without smoothing and the
    largest overall variance, which the smoothing is a share of."""
    classes: np.ndarray
    log_prior: np.ndarray
    mean: np.ndarray
    var: np.ndarray
    top_var: float

    @staticmethod
    def of(moments: dict[tuple[int, float], Moments], without: int) -> FoldModel:
        parts: dict[float, list[Moments]] = {}
        for (fold, y), m in sorted(moments.items()):
            if fold != without:
                parts.setdefault(y, []).append(m)
        own = {y: _merge(p) for y, p in sorted(parts.items())}
        total = _merge(list(own.values()))
        return FoldModel(np.array(list(own)), np.log([m.n / total.n for m in own.values()]),
                         np.array([m.mean for m in own.values()]), np.array([m.dev / m.n for m in own.values()]),
                         float((total.dev / total.n).max(initial=0.0)))

    def predict(self, x: np.ndarray, smoothings: list[float]) -> list[np.ndarray]:
        """Index of the likeliest class of each row for each smoothing; the smaller class wins a tie."""
        var = [self.var + s * self.top_var for s in smoothings]
        scores = np.empty((len(smoothings), len(self.mean), len(x)))
        for c, mean in enumerate(self.mean):
            gap = (x - mean) ** 2
            for i, v in enumerate(var):
                const = self.log_prior[c] - 0.5 * np.log(2 * math.pi * v[c]).sum()
                scores[i, c] = const - 0.5 * (gap / v[c]).sum(axis=1)
        return list(scores.argmax(axis=1))


def matrix(column: pa.Array) -> np.ndarray:
    """A column of arrays of one length as a matrix, without a Python object per row."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float, copy=False)


def counted(truth: np.ndarray, found: np.ndarray, test: np.ndarray, k: int) -> np.ndarray:
    """Rows by (side, class, predicted class) as whole numbers."""
    return np.bincount((test * k + truth) * k + found, minlength=2 * k * k)


def pair_rows(total: dict[tuple[int, int], np.ndarray], classes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """PAIR_COUNTS rows of the counts of every (combination, fold)."""
    k = len(classes)
    for (i, fold), n in total.items():
        cell = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({
            "combo": pa.array(np.full(len(cell), i), pa.int32()), "fold": pa.array(np.full(len(cell), fold), pa.int32()),
            "test": pa.array(cell >= k * k), "y": pa.array(classes[cell // k % k]), "p": pa.array(classes[cell % k]),
            "n": pa.array(n[cell], pa.int64())})


def naive_bayes_counts(data: DataFrame, smoothings: list[float], folds: int, features: str = "features",
                       label: str = "label") -> list[tuple[int, int, bool, float, float, int]]:
    """(combination, fold, on the test side, class, predicted class, rows) of all models of the search."""
    moments = fold_moments(data, features, label)
    models = {f: FoldModel.of(moments, f) for f in range(folds) if any(g != f for g, _ in moments)}

    classes = np.array(sorted({y for _, y in moments}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x"))
            truth, at = np.searchsorted(classes, batch.column("y").to_numpy()), batch.column("fold").to_numpy()
            step = max(1, SCORE_CELLS // max(1, x.shape[1], len(classes) * len(smoothings)))
            for s in range(0, len(x), step):
                for f, model in models.items():
                    own = np.searchsorted(classes, model.classes)
                    for i, p in enumerate(model.predict(x[s:s + step], smoothings)):
                        pairs = counted(truth[s:s + step], own[p], at[s:s + step] == f, len(classes))
                        total[i, f] = total.get((i, f), 0) + pairs
        yield from pair_rows(total, classes)

    rows = data.select(vector_to_array(F.col(features)).alias("x"), F.col(label).cast("double").alias("y"), "fold")
    counts = rows.mapInArrow(run, PAIR_COUNTS).groupBy("combo", "fold", "test", "y", "p").agg(F.sum("n").alias("n"))
    return [tuple(r) for r in bounded(counts, "classes x classes x models", MAX_COUNTS)]
