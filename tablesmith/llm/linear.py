"""Hashed linear models: features as arrays of hashed indices, made by Spark, and
logistic regression fitted with numpy on a bounded sample."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def hashed(words: Column, size: int, seed: str = "") -> Column:
    """The distinct hashed indices of an array of words."""
    return F.array_distinct(F.transform(words, lambda w: F.pmod(F.xxhash64(w, F.lit(seed)), F.lit(size)).cast("int")))


class Rows:
    """Sparse 0/1 rows, each scaled by ``scale``, plus dense columns."""

    def __init__(self, indices: pd.Series, size: int, scale: np.ndarray | None = None, dense: np.ndarray | None = None):
        lengths = np.array([len(x) for x in indices], dtype=np.int64)
        self.n, self.size = len(lengths), size
        self.of = np.repeat(np.arange(self.n), lengths)
        self.index = np.concatenate(indices.to_list()).astype(np.int64) if lengths.sum() else np.zeros(0, np.int64)
        self.value = (np.ones(self.n) if scale is None else scale)[self.of]
        self.dense = np.zeros((self.n, 0)) if dense is None else dense

    @property
    def width(self) -> int:
        return self.size + self.dense.shape[1] + 1

    def margins(self, w: np.ndarray) -> np.ndarray:
        sparse = np.bincount(self.of, weights=self.value * w[self.index], minlength=self.n)
        return sparse + self.dense @ w[self.size:-1] + w[-1]

    def back(self, r: np.ndarray) -> np.ndarray:
        sparse = np.bincount(self.index, weights=self.value * r[self.of], minlength=self.size)
        return np.concatenate((sparse, self.dense.T @ r, [r.sum()]))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: Rows, y: np.ndarray, weight: np.ndarray, strength: float, rounds: int = 30, memory: int = 6) -> np.ndarray:
    """Weights, the intercept last, of an L2 logistic regression on targets ``y`` in [0, 1], by L-BFGS."""
    total = max(weight.sum(), 1e-12)

    def loss(w):
        m = rows.margins(w)
        value = (weight * (np.logaddexp(0, m) - y * m)).sum() / total + strength / 2 * (w[:-1] ** 2).sum()
        grad = rows.back(weight * (sigmoid(m) - y)) / total
        grad[:-1] += strength * w[:-1]
        return value, grad

    w = np.zeros(rows.width)
    value, grad = loss(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        step, used = grad.copy(), []
        for s, d, rho in reversed(past):
            used.append(rho * (s @ step))
            step -= used[-1] * d
        if past:
            s, d, _ = past[-1]
            step *= (s @ d) / (d @ d)
        for (s, d, rho), a in zip(past, reversed(used), strict=True):
            step += (a - rho * (d @ step)) * s
        rate = 1.0 if past else 1.0 / max(1.0, np.abs(grad).max())
        while True:
            new = w - rate * step
            new_value, new_grad = loss(new)
            if new_value <= value - 1e-4 * rate * (grad @ step) or rate < 1e-8:
                break
            rate /= 2
        s, d = new - w, new_grad - grad
        if s @ d > 1e-12:
            past = [*past, (s, d, 1 / (s @ d))][-memory:]
        done = value - new_value < 1e-7 * max(1.0, abs(value))
        w, value, grad = new, new_value, new_grad
        if done:
            break
    return w
