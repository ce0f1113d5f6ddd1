"""Linear SVMs of large tables, all classes and calibration sides in the same passes (M6).

Spark's LinearSVC keeps the table it fits on; projected to hundreds of Fourier components it is a hundred times the
input. Here only the features are kept, as chunks of bytes, and every pass projects them anew, batch by batch, for the
losses and gradients of all (side, class) problems at once. The objective and the stopping rule are those of LinearSVC:
weighted mean hinge loss plus regParam / 2 |coefficients|^2, no penalty on the intercept; done when the loss of the last
twenty steps changed by at most ``tol`` of the first one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.columns import bounded
from ...session import cut_lineage
from ..fold_stats import matrix

STEP_ROWS = 4096        # rows projected at once
MEMORY, HISTORY = 10, 20


@dataclass
class Projection:
    """sqrt(2/D) cos(W x + b), or x itself."""
    w: np.ndarray | None = None
    b: np.ndarray | None = None

    def of(self, x: np.ndarray) -> np.ndarray:
        if self.w is None:
            return x
        z = x @ self.w.T
        z += self.b
        np.cos(z, out=z)
        z *= np.sqrt(2.0 / len(self.b))
        return z


@dataclass
class Descent:
    """L-BFGS with backtracking for one problem, a step at a time: ``trial`` is the point whose loss and gradient are
    wanted next."""
    trial: np.ndarray
    tol: float
    max_iter: int
    at: np.ndarray | None = None
    loss: float = np.inf
    slope: np.ndarray | None = None
    direction: np.ndarray | None = None
    step: float = 1.0
    moves: list[tuple] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    first: float = 1.0
    turns: int = 0
    done: bool = False

    def tell(self, loss: float, slope: np.ndarray) -> None:
        if self.at is None:
            self.first = abs(loss)
        elif not loss <= self.loss + 1e-4 * self.step * float(self.slope @ self.direction):
            self.step /= 2
            if self.step < 1e-10:
                if not self.moves:      # no way down along the gradient either
                    self.done = True
                    return
                self.moves = []
                self._turn()
                return
            self.trial = self.at + self.step * self.direction
            return
        else:
            s, y = self.trial - self.at, slope - self.slope
            if float(s @ y) > 0:
                self.moves = [*self.moves, (s, y)][-MEMORY:]
        self.at, self.loss, self.slope = self.trial, loss, slope
        self.losses = [*self.losses, loss][-HISTORY:]
        self.turns += 1
        flat = len(self.losses) >= 2 and max(self.losses) - loss <= self.tol * self.first
        if flat or self.turns > self.max_iter or float(np.linalg.norm(slope)) <= max(self.tol * abs(loss), 1e-8):
            self.done = True
            return
        self._turn()

    def _turn(self) -> None:
        q, used = self.slope.copy(), []
        for s, y in reversed(self.moves):
            a = float(s @ q) / float(s @ y)
            q -= a * y
            used.append(a)
        if self.moves:
            s, y = self.moves[-1]
            q *= float(s @ y) / float(y @ y)
        for (s, y), a in zip(self.moves, reversed(used)):
            q += (a - float(y @ q) / float(s @ y)) * s
        self.direction = -q
        self.step = 1.0 if self.moves else 1.0 / max(float(np.linalg.norm(self.slope)), 1e-12)
        self.trial = self.at + self.step * self.direction


def packed(data: DataFrame, weight: str | None) -> DataFrame:
    """(x, y, w, fold) as bytes of many rows each, checkpointed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y, w, fold = matrix(batch.column("x")), *(batch.column(c).to_numpy() for c in ("y", "w", "fold"))
                if not np.isfinite(x).all() or not np.isfinite(y.astype(float)).all() or not (w >= 0).all():
                    raise ValueError("features and labels must be finite numbers, weights not negative")
                yield pa.RecordBatch.from_pydict({c: pa.array([v.tobytes()], pa.binary()) for c, v in (
                    ("x", x), ("y", y.astype(float)), ("w", w.astype(float)), ("fold", fold.astype(np.int16)))})

    rows = data.select(vector_to_array(F.col("features")).alias("x"), F.col("label").cast("double").alias("y"),
                       (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"), "fold")
    return cut_lineage(rows.mapInArrow(run, "x binary, y binary, w binary, fold binary"))


def fitted(chunks: DataFrame, projection: Projection, width: int, classes: np.ndarray, sides: list[int | None], reg: float,
           tol: float, max_iter: int) -> dict[int | None, tuple[np.ndarray, np.ndarray]]:
    """(coefficients of each class as columns, intercepts) of every side: the rows outside a fold, or all (None)."""
    problems = [(side, c) for side in sides for c in range(len(classes))]
    descents = [Descent(np.zeros(width + 1), tol, max_iter) for _ in problems]
    while live := [p for p, d in enumerate(descents) if not d.done]:
        for p, (loss, weight, slope) in zip(live, _losses(chunks, projection, width, classes, [problems[p] for p in live],
                                                         np.stack([descents[p].trial for p in live], axis=1))):
            beta, size = descents[p].trial.copy(), max(weight, 1e-300)
            beta[-1] = 0.0
            descents[p].tell(loss / size + reg / 2 * float(beta @ beta), slope / size + reg * beta)
    found = {side: np.stack([d.at for (s, _), d in zip(problems, descents) if s == side], axis=1) for side in sides}
    return {side: (points[:-1], points[-1]) for side, points in found.items()}


def _losses(chunks: DataFrame, projection: Projection, width: int, classes: np.ndarray, problems: list[tuple],
            points: np.ndarray) -> list[tuple[float, float, np.ndarray]]:
    """(hinge loss, weight, gradient) of every problem at its point, summed over the rows."""
    own = classes[[c for _, c in problems]]
    out = np.array([-1 if side is None else side for side, _ in problems])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 3, len(problems)))
        for batch in batches:
            for i in range(batch.num_rows):
                y, w, fold, x = (np.frombuffer(batch.column(c)[i].as_py(), dtype=t) for c, t in (
                    ("y", float), ("w", float), ("fold", np.int16), ("x", float)))
                x = x.reshape(len(y), -1)
                for s in range(0, len(y), STEP_ROWS):
                    part = slice(s, s + STEP_ROWS)
                    z = projection.of(x[part])
                    side = np.where(y[part, None] == own, 1.0, -1.0)
                    weight = w[part, None] * (fold[part, None] != out)
                    short = 1.0 - side * (z @ points[:-1] + points[-1])
                    pull = np.where(short > 0, -side * weight, 0.0)
                    total[:width] += z.T @ pull
                    total[width] += pull.sum(axis=0)
                    total[width + 1] += (np.maximum(short, 0.0) * weight).sum(axis=0)
                    total[width + 2] += weight.sum(axis=0)
        yield pa.RecordBatch.from_pydict({"total": pa.array([total.tobytes()], pa.binary())})

    parts = bounded(chunks.mapInArrow(run, "total binary"), "partitions", 1_000_000)
    total = sum(np.frombuffer(r["total"]).reshape(width + 3, -1) for r in parts)
    return [(float(t[width + 1]), float(t[width + 2]), t[:width + 1]) for t in total.T]


def margins(data: DataFrame, projection: Projection, models: dict[int | None, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(label, rawPrediction): margins of every row under the SVM of its fold, or the one of all rows."""
    @F.arrow_udf("array<double>")
    def of(x: pa.Array, fold: pa.Array) -> pa.Array:
        at, rows, k = fold.to_numpy(zero_copy_only=False), len(x), len(next(iter(models.values()))[1])
        found, x = np.zeros((rows, k)), matrix(x) if rows else np.zeros((0, 1))
        for s in range(0, rows, STEP_ROWS):
            part = slice(s, s + STEP_ROWS)
            z = projection.of(x[part])
            for side, (coef, intercept) in models.items():
                here = np.ones(len(z), dtype=bool) if side is None else at[part] == side
                found[part][here] = z[here] @ coef + intercept
        return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * k, pa.int32()), pa.array(found.reshape(-1)))

    return data.select("label", array_to_vector(of(vector_to_array(F.col("features")), F.col("fold"))).alias("rawPrediction"))
