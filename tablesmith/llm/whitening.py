"""Embedding whitening from an exact bit-sliced scatter.

An entry c becomes the integer x = floor(64 c) + 1000000. The fit list is every distinct
x-vector once. A task takes its rows in blocks, subtracts each dimension's smallest
value of the block and packs each bit plane of each dimension across the rows into 64-bit
words; the AND of two planes, counted by popcount and weighted by the planes' two powers of
two, summed over all pairs of planes, is the exact cross-product of two dimensions.
Blocks are brought back to one origin in whole numbers, Spark adds the partial
products of the tasks (one row per pair of dimensions) as decimals, and the matrix
n * X'X - S S' is centred as whole numbers before it is divided by n * n and handed to eigh.

Rows are then projected where they lie: (n * x - S) is exact, its quotient by n is the only
rounding before the projection. ``identity_error`` is measured, not derived: one more
pass over the fit list adds the cross-products of its whitened rows.

What the driver holds follows the dimensions alone (at most ``MAX_DIMENSIONS``): the
products, the components and the sums. Distinct vectors are found with map-side
combine, so a vector that repeats in a third of all rows costs one row per task.

Defined results: null vectors and those that hold a null or non-finite entry are
dropped; rows are kept as often as they repeat and whatever their id, null included;
vectors of different lengths are whitened apart, each length against its own fit list; an
empty vector has no component and gives no row, and an empty table gives an empty result;
a direction without variance (below the rounding of eigh) has explained 0 and
whitened null, and is left out of identity_error; entries beyond 2^40 count as 2^40;
deviation is a decimal here and null in the digest where no long can hold it; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.common import stored

SCALE = 64
ORIGIN = 1_000_000
BLOCK_ROWS = 8192
COMPONENTS = 16
MAX_DIMENSIONS = 2048
MAX_LENGTHS = 1000


def integer_vectors(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """``rows`` that remain, with _x, the array of longs."""
    v = F.col(f"`{column}`").cast("array<double>")
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    top = float(1 << 40)
    return rows.where(v.isNotNull()).where(good).withColumn("_x", F.transform(v, lambda c: F.floor(
        F.lit(float(SCALE)) * F.greatest(F.least(c, F.lit(top)), F.lit(-top))).cast("long") + F.lit(ORIGIN)))


def bit_planes(shifted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, dimension, power): one row of 64-bit words per bit plane that has a set bit anywhere."""
    n, d = shifted.shape
    width = -(-n // 64)
    words, dims, powers = [], [], []
    for j in range(d):
        column = shifted[:, j]
        for p in range(int(column.max()).bit_length()):
            bits = np.zeros(width * 64, dtype=np.uint8)
            bits[:n] = (column >> np.uint64(p)) & np.uint64(1)
            words.append(np.packbits(bits, bitorder="little").view(np.uint64))
            dims.append(j)
            powers.append(p)
    return np.array(words, dtype=np.uint64).reshape(len(words), width), np.array(dims, dtype=int), np.array(powers, dtype=int)


def block_scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, cross-products) of the rows of x about ORIGIN, as whole numbers of any size."""
    n, d = x.shape
    low = x.min(axis=0)
    planes, dims, powers = bit_planes((x - low).astype(np.uint64))
    inner = np.zeros((d, d), dtype=object)
    if len(planes):
        starts = np.flatnonzero(np.r_[True, dims[1:] != dims[:-1]])  # planes of a dimension are neighbours
        used, top = dims[starts], int(powers.max())
        small = 2 * top + n.bit_length() + 2 < 62  # then the weighted sums fit in 64 bits
        weight = np.left_shift(1, powers) if small else np.array([1 << int(p) for p in powers], dtype=object)
        for i in range(len(planes)):
            counts = np.bitwise_count(planes & planes[i]).sum(axis=1, dtype=np.int64)
            by_dim = np.add.reduceat(counts * weight if small else counts.astype(object) * weight, starts)
            inner[dims[i], used] += by_dim * (1 << int(powers[i])) if not small else (by_dim << powers[i]).astype(object)
    sums = (x - low).sum(axis=0).astype(object)
    shift = low.astype(object) - ORIGIN
    across = np.multiply.outer(shift, sums)
    return sums + n * shift, inner + across + across.T + n * np.multiply.outer(shift, shift)


def _matrix(batch: pd.DataFrame) -> np.ndarray:
    return np.array(batch["_x"].tolist(), dtype=np.int64).reshape(len(batch), -1)


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
    held, rows = [], 0
    for batch in batches:
        if len(batch):
            held.append(_matrix(batch))
            rows += len(batch)
        if rows >= BLOCK_ROWS:
            yield np.concatenate(held)
            held, rows = [], 0
    if rows:
        yield np.concatenate(held)


def _partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's row count (i = j = -1), sums (j = -1) and cross-products (i <= j)."""
    n, sums, cross = 0, None, None
    for x in _blocks(batches):
        s, c = block_scatter(x)
        n, sums, cross = n + len(x), s if sums is None else sums + s, c if cross is None else cross + c
    if n:
        i, j = np.triu_indices(len(sums))
        yield pd.DataFrame({"i": np.r_[-1, np.arange(len(sums)), i], "j": np.r_[-1, np.full(len(sums), -1), j],
                            "v": [Decimal(n), *map(Decimal, sums), *map(Decimal, cross[i, j])]})


class Whitening:
    """Fitted on sums and products about ORIGIN of a fit list: n, S (Python ints), components (rows, unit length), eigenvalues, shares of the variance."""

    def __init__(self, n: int, sums: list[int], products: np.ndarray, components: int = COMPONENTS):
        d = len(sums)
        about = np.array(sums, dtype=object)
        centred = n * products - np.multiply.outer(about, about)  # the origin cancels out
        self.n, self.sums = n, [s + n * ORIGIN for s in sums]
        over = n * n
        v = np.array([[int(a) / over for a in row] for row in centred], dtype=float).reshape(d, d)
        values, vectors = np.linalg.eigh(v)
        order = np.argsort(-values, kind="stable")[:components]
        self.values, self.vectors = values[order], vectors[:, order].T
        heaviest = np.abs(self.vectors).argmax(axis=1)
        self.vectors = self.vectors * np.sign(self.vectors[np.arange(len(order)), heaviest])[:, None]
        total = float(np.trace(v))
        self.live = self.values > max(values.max(), 0.0) * d * np.finfo(float).eps
        self.explained = np.where(self.live, self.values / total if total > 0 else 0.0, 0.0)
        self.identity_error = 0.0

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: as 64-bit numbers where their squares' sum fits, else as Python ints."""
        low, high = int(x.min()), int(x.max())
        far = max(abs(self.n * low - min(self.sums)), abs(self.n * high - max(self.sums)),
                  abs(self.n * low - max(self.sums)), abs(self.n * high - min(self.sums)))
        kind = np.int64 if far * far * len(self.sums) < 1 << 62 and self.n * max(abs(low), abs(high)) < 1 << 62 else object
        return x.astype(kind) * self.n - np.array(self.sums, dtype=kind)

    def project(self, dev: np.ndarray) -> np.ndarray:
        """Whitened rows; NaN in directions without variance."""
        z = (dev / self.n).astype(float) @ self.vectors.T
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.live, z / np.sqrt(np.where(self.live, self.values, 1.0)), np.nan)


def fit(vectors: DataFrame, length: int, components: int = COMPONENTS) -> Whitening | None:
    """Fit on the distinct _x of ``vectors`` of one length; None without rows."""
    if length > MAX_DIMENSIONS:
        raise ValueError(f"vectors of {length} entries; at most {MAX_DIMENSIONS}")
    parts = vectors.select("_x").mapInPandas(_partials, "i int, j int, v decimal(38,0)")
    rows = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # bounded by the dimensions
    if not rows:
        return None
    n, sums, products = 0, [0] * length, np.zeros((length, length), dtype=object)
    for i, j, v in rows:
        if i < 0:
            n = int(v)
        elif j < 0:
            sums[i] = int(v)
        else:
            products[i, j] = products[j, i] = int(v)
    model = Whitening(n, sums, products, components)
    model.identity_error = _identity_error(vectors, model)
    return model


def _identity_error(vectors: DataFrame, model: Whitening) -> float:
    live = int(model.live.sum())
    if not live:
        return 0.0

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((live + 1, live + 1))
        for x in _blocks(batches):
            z = np.c_[model.project(model.deviations(x))[:, model.live], np.ones(len(x))]
            total += z.T @ z
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    got = np.zeros((live + 1, live + 1))
    for i, j, v in vectors.select("_x").mapInPandas(products, "i int, j int, v double").groupBy("i", "j").agg(
            F.sum("v")).collect():
        got[i, j] = v / model.n
    mean = got[live, :live]  # zero but for rounding
    return float(np.abs(got[:live, :live] - np.multiply.outer(mean, mean) - np.eye(live)).max())


def whiten(rows: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, n, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error of
    every remaining row."""
    kept = integer_vectors(rows.select("vec_id", F.col(f"`{column}`").alias("embedding")))
    distinct = stored(kept.select("_x").distinct(), "whiten-fit")
    lengths = [r[0] for r in distinct.select(F.size("_x").alias("d")).distinct().limit(MAX_LENGTHS + 1).collect()]
    if len(lengths) > MAX_LENGTHS:
        raise ValueError(f"vectors of more than {MAX_LENGTHS} lengths")
    models = {d: fit(distinct.where(F.size("_x") == d), d, components) for d in sorted(lengths) if d}
    schema = ("vec_id string, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, "
              "identity_error double")

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, part in batch.groupby(batch["_x"].map(len)):
                model = models.get(d)
                if model is None:
                    continue
                dev = model.deviations(_matrix(part))
                squares = (dev * dev).sum(axis=1)
                yield pd.DataFrame({
                    "vec_id": part["vec_id"].array, "n": model.n,
                    "deviation": [Decimal(int(s)) if abs(int(s)) < 10 ** 38 else None for s in squares],
                    "whitened": [[None if np.isnan(a) else a for a in z] for z in model.project(dev).tolist()],
                    "explained": [model.explained.tolist()] * len(part), "identity_error": model.identity_error})

    # the id travels as text: pandas would turn longs beside nulls into doubles
    return kept.select(F.col("vec_id").cast("string"), "_x").mapInPandas(project, schema).withColumn(
        "vec_id", F.col("vec_id").cast("long"))


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """Contract digest of ``whiten`` on the whole of ``embeddings``: a row per vector and component."""
    out = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    pairs = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "z")
    return out.select("vec_id", "n", F.expr("try_cast(deviation AS long)").alias("deviation"), "identity_error", pairs).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("z.whitened").alias("whitened"),
        F.col("z.explained").alias("explained"), "identity_error")
