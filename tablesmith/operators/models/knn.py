"""M2: exact k-nearest-neighbour classifier as a Spark ML Estimator.

The "model" is the training table itself (kept as a DataFrame, saved as Parquet). Its rows
are grouped by their nearest pivot and sorted by the distance to it, in blocks of at most
``blockRows``. A query is compared with a block only if the triangle inequality
allows a row of it to be among the k nearest: a first round into the nearest blocks
gives an upper bound of the k-th distance, the second round skips every block whose lower
bound is larger (``PivotSearch``). Each (query block, block) pair that is left is one
``cogroup`` task that computes distances with numpy and emits its local k best;
``row_number() <= k`` keeps the global k best. Work per task is bounded by the block
sizes; no pair list is materialised, nothing is broadcast, and the result is exact.

Ties: among equal distances the smaller training id wins; among classes
with equal votes the smaller class wins. With distance weights, a test row
at distance 0 from some neighbours counts only those neighbours.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...functions.columns import bounded
from ...session import cut_lineage, spread
from ..ranking import running_totals

DEFAULT_BLOCK_ROWS = 10_000


STEP_CELLS = 2_000_000      # differences held at once: 16 MB
TILE = 64, 2048             # queries and rows whose manhattan sums are added up in the processor's cache
LARGE = 1e18                # beyond it squares or sums in single precision lose their range
MAX_PIVOTS = 1024
MAX_BLOCKS = 1_000_000
CHUNKS = 1 << 20            # block and query-block ids are pivot * CHUNKS + number
SLACK = 1e-9                # bounds are loosened by more than the rounding of a distance


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of the rows of a to the rows of b."""
    if metric == "manhattan":
        return np.abs(a[:, None, :] - b[None, :, :]).sum(axis=2)
    return np.sqrt(np.maximum(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2), 0.0))


def _steps(a: np.ndarray, b: np.ndarray):
    """Slices of the rows of a whose differences to all rows of b fit in STEP_CELLS."""
    size = max(1, STEP_CELLS // max(1, b.size))
    return (slice(s, s + size) for s in range(0, len(a), size))


def _pair_distances(a: np.ndarray, b: np.ndarray, row: np.ndarray, column: np.ndarray, metric: str) -> np.ndarray:
    """``distances`` of the given pairs of rows."""
    size = max(1, STEP_CELLS // max(1, a.shape[1]))
    out = np.empty(len(row))
    for s in range(0, len(row), size):
        gap = a[row[s:s + size]] - b[column[s:s + size]]
        out[s:s + size] = np.abs(gap).sum(axis=1) if metric == "manhattan" else np.sqrt((gap ** 2).sum(axis=1))
    return out


class _Rough:
    """Distances of queries to all rows of a block in cheap arithmetic, with a bound of their error for each query:
    squares of the euclidean distance by a matrix product, manhattan sums in single precision."""

    def __init__(self, rows: np.ndarray, metric: str):
        self.metric, self.centre = metric, rows.mean(axis=0)
        self.rows = self._placed(rows)
        size = np.abs(self.rows).sum(axis=1, dtype=float) if metric == "manhattan" else (self.rows ** 2).sum(axis=1)
        self.size, self.widest = size, float(size.max())
        self.unit = 8 * (rows.shape[1] + 8) * np.finfo(self.rows.dtype).eps

    def _placed(self, x: np.ndarray) -> np.ndarray:
        return (x - self.centre).astype(np.float32 if self.metric == "manhattan" else np.float64)

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self._placed(x)
        if self.metric == "manhattan":
            return self._sums(x), self.unit * (np.abs(x).sum(axis=1, dtype=float) + self.widest)
        size = (x ** 2).sum(axis=1)
        d = x @ self.rows.T
        d *= -2.0
        d += self.size
        d += size[:, None]
        return d, self.unit * (size + self.widest)

    def _sums(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.rows)), dtype=np.float32)
        columns = np.ascontiguousarray(self.rows.T)
        for q in range(0, len(x), TILE[0]):
            for r in range(0, len(self.rows), TILE[1]):
                total = out[q:q + TILE[0], r:r + TILE[1]]
                gap = np.empty_like(total)
                for j in range(x.shape[1]):
                    np.subtract(x[q:q + TILE[0], j, None], columns[j, r:r + TILE[1]], out=gap)
                    total += np.abs(gap, out=gap)
        return out

    @staticmethod
    def fits(*tables: np.ndarray) -> bool:
        """Whether all entries are finite and their sums and squares in range."""
        return all(bool((np.abs(t) < LARGE).all()) for t in tables)


def nearest_rows(points: np.ndarray, rows: np.ndarray, tids: np.ndarray, limit: np.ndarray, k: int, metric: str):
    """(query, row, distance) arrays of the k nearest rows of each query that are not beyond its limit; of equal distances
    the smaller id. Rough distances leave out what cannot be among them; the rest gets its exact distance."""
    kk = min(k, len(rows))
    rough = _Rough(rows, metric) if _Rough.fits(points, rows) else None
    size = max(1, (STEP_CELLS if rough else STEP_CELLS // max(1, rows.shape[1])) // len(rows))
    for s in range(0, len(points), size):
        x, most = points[s:s + size], limit[s:s + size]
        if rough:
            d, slack = rough.of(x)
            cap = (most if metric == "manhattan" else most ** 2) * (1 + SLACK) + slack
        else:
            d, slack, cap = distances(x, rows, metric), 0.0, most
        keep = d <= cap[:, None]
        if int(keep.sum()) > 2 * kk * len(x):
            cap = np.fmin(cap, np.partition(d, kk - 1, axis=1)[:, kk - 1] + 2 * slack)
            keep = d <= cap[:, None]
        row, column = np.nonzero(keep)
        dist = _pair_distances(x, rows, row, column, metric) if rough else d[row, column]
        within = dist <= most[row]
        row, column, dist = row[within], column[within], dist[within]
        order = np.lexsort((tids[column], dist, row))
        row, column, dist = row[order], column[order], dist[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        yield row[place < kk] + s, column[place < kk], dist[place < kk]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


@dataclass
class Blocks:
    """Pivots, and of every block its number, the smallest and the largest distance to its pivot and its rows."""
    metric: str
    pivots: np.ndarray
    block: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    n: np.ndarray

    def bounds(self, to_pivots: np.ndarray) -> np.ndarray:
        """Smallest distance a row of each block can have (rows: queries, columns: blocks), by the triangle inequality:
        on the block's distances to its pivot, and on its rows' being nearer to that pivot than to the query's own."""
        d = to_pivots[:, self.block // CHUNKS]
        half = (d - to_pivots.min(axis=1)[:, None]) / 2
        bound = np.maximum(np.maximum(d - self.hi, self.lo - d), np.maximum(half, 0.0))
        return bound - SLACK * (1.0 + d)

    def first_blocks(self, bounds: np.ndarray, k: int) -> np.ndarray:
        """Mask of the blocks of the smallest bounds that together hold k rows."""
        order = np.argsort(bounds, axis=1, kind="stable")
        before = np.cumsum(self.n[order], axis=1) - self.n[order]
        mask = np.zeros(bounds.shape, dtype=bool)
        np.put_along_axis(mask, order, before < k, axis=1)
        return mask


class PivotIndex:
    """Training rows by their nearest pivot, each pivot's rows cut into blocks of consecutive distance to it.

    The pivots (at most MAX_PIVOTS rows of the smallest id hashes) and one row per block
    (pivot, smallest and largest distance, rows) are on the driver; the rows are
    checkpointed with their block. A pivot's rows are counted off by running totals, so a
    pivot that holds most rows is ordered in ranges."""

    def __init__(self, train: DataFrame, metric: str, block_rows: int):
        self.metric, self.block_rows = metric, block_rows
        wanted = min(MAX_PIVOTS, max(1, math.ceil(train.count() / max(1, block_rows // 2))))
        sample = train.select("x").orderBy(F.xxhash64("tid"), "tid").limit(4 * wanted).collect()
        points = np.unique(np.array([r["x"] for r in sample], dtype=float), axis=0) if sample else np.zeros((0, 0))
        # spread over the sample's order, not its first values only
        pivots = points[np.unique(np.linspace(0, max(0, len(points) - 1), wanted).astype(int))] if len(points) else points

        def nearest(batches):
            for batch in batches:
                if len(batch):
                    x = _matrix(batch["x"])
                    at, dist = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
                    for part in _steps(x, pivots):
                        d = distances(x[part], pivots, metric)
                        at[part] = d.argmin(axis=1)
                        dist[part] = d.min(axis=1)
                    yield batch.assign(pivot=at, pd=dist, one=1)

        placed = train.select("x", "y", "tid").mapInPandas(
            nearest, "x array<double>, y double, tid long, pivot long, pd double, one long")
        counted = running_totals(placed, ["pivot"], ["pd", "tid"], ["one"])
        self.rows = cut_lineage(counted.select("x", "y", "tid", "pd", (
            F.col("pivot") * CHUNKS + F.floor((F.col("one_cum") - 1) / block_rows)).cast("long").alias("block")))
        blocks = bounded(self.rows.groupBy("block").agg(F.min("pd").alias("lo"), F.max("pd").alias("hi"), F.count("*").alias("n")),
                         "blocks of training rows", MAX_BLOCKS)
        blocks.sort()
        self.blocks = Blocks(metric, pivots, *(np.array([r[c] for r in blocks], dtype=kind) for c, kind in (
            ("block", np.int64), ("lo", float), ("hi", float), ("n", np.int64))))


def looked_up(routed: DataFrame, rows: DataFrame, k: int, metric: str, qtype: str) -> DataFrame:
    """The k best rows of each (query, block) of ``routed`` (qid, x, limit, qb, block), not beyond the query's limit;
    ``rows`` (x, y, tid, block) are sent to the query blocks that ask for their block."""
    def local_topk(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        cols = {"qid": [], "tid": [], "dist": [], "y": []}
        if q.empty or r.empty:
            return pd.DataFrame(cols)
        points, near_rows = _matrix(q["x"]), _matrix(r["x"])
        tids, ys, qids, limit = r["tid"].to_numpy(), r["y"].to_numpy(), q["qid"].to_numpy(), q["limit"].to_numpy(dtype=float)
        for row, column, dist in nearest_rows(points, near_rows, tids, limit, k, metric):
            cols["qid"].append(qids[row])
            cols["tid"].append(tids[column])
            cols["dist"].append(dist)
            cols["y"].append(ys[column])
        return pd.DataFrame({c: np.concatenate(v) for c, v in cols.items()})

    pairs = routed.select(F.col("qb").alias("to_qb"), F.col("block").alias("to_block")).distinct()
    sent = rows.join(pairs, F.col("block") == F.col("to_block")).select("x", "y", "tid", "to_qb", "to_block")
    return (routed.groupBy("qb", "block").cogroup(sent.groupBy("to_qb", "to_block"))
            .applyInPandas(local_topk, f"qid {qtype}, tid long, dist double, y double"))


def best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query, with their rank."""
    w = Window.partitionBy("qid").orderBy("dist", "tid")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class PivotSearch:
    """Exact k nearest rows in two rounds. Round one looks into the blocks with the smallest bounds until k rows
    are seen; the k-th distance found is an upper bound. Round two looks only into the blocks whose lower bound does
    not exceed it. Queries are dealt by their nearest pivot, so neighbours in space ask for the same blocks, and a block
    is sent only to the query blocks that need it."""

    def __init__(self, index: PivotIndex, queries: DataFrame, k: int):
        self.index, self.k = index, k
        self.qtype = queries.schema["qid"].dataType.simpleString()
        pivots, metric = index.blocks.pivots, index.metric

        def home(batches):
            for batch in batches:
                if len(batch):
                    x = _matrix(batch["x"])
                    at = np.zeros(len(x), dtype=np.int64)
                    for part in _steps(x, pivots):
                        at[part] = distances(x[part], pivots, metric).argmin(axis=1)
                    yield batch.assign(home=at)

        if not len(pivots):
            self.queries = queries.withColumn("qb", F.lit(0).cast("long")).where("false")
            return
        placed = queries.select("qid", "x").mapInPandas(home, f"qid {self.qtype}, x array<double>, home long")
        sizes = {r["home"]: r["count"] for r in placed.groupBy("home").count().collect()}  # one row per pivot at most
        chunks = F.array(*[F.lit(max(1, math.ceil(sizes.get(p, 0) / index.block_rows))) for p in range(len(pivots))])
        chunk = F.pmod(F.xxhash64("qid"), F.get(chunks, F.col("home").cast("int")))
        self.queries = placed.select("qid", "x", (F.col("home") * CHUNKS + chunk).alias("qb"))

    def _routed(self, queries: DataFrame, second: bool) -> DataFrame:
        """(qid, x, limit, qb, block): the blocks each query looks into in a round."""
        blocks, k = self.index.blocks, self.k

        def route(batches):
            for batch in batches:
                if batch.empty:
                    continue
                x = _matrix(batch["x"])
                widest = max(len(blocks.pivots) * x.shape[1], len(blocks.block))
                for part in _steps(x, np.empty(widest)):
                    bound = blocks.bounds(distances(x[part], blocks.pivots, blocks.metric))
                    first = blocks.first_blocks(bound, k)
                    need = ~first & (bound <= batch["limit"].to_numpy(dtype=float)[part][:, None]) if second else first
                    row, column = np.nonzero(need)
                    yield batch.iloc[part].iloc[row].assign(block=blocks.block[column])

        return queries.select("qid", "x", "limit", "qb").mapInPandas(
            route, f"qid {self.qtype}, x array<double>, limit double, qb long, block long")

    def round_one(self) -> DataFrame:
        return self._routed(self.queries.withColumn("limit", F.lit(float("inf"))), second=False)

    def round_two(self, found: DataFrame) -> DataFrame:
        limit = found.groupBy("qid").agg(F.when(F.count("*") < self.k, float("inf")).otherwise(F.max("dist")).alias("limit"))
        return self._routed(self.queries.join(limit, "qid"), second=True)

    def _looked_up(self, routed: DataFrame) -> DataFrame:
        return looked_up(routed, self.index.rows, self.k, self.index.metric, self.qtype)

    def _best(self, found: DataFrame) -> DataFrame:
        return best(found, self.k)

    def first_found(self) -> DataFrame:
        return self._best(self._looked_up(self.round_one()))

    def neighbours(self) -> DataFrame:
        """(qid, tid, dist, y, rank)."""
        if not len(self.index.blocks.pivots):
            return self.queries.sparkSession.createDataFrame([], f"qid {self.qtype}, tid long, dist double, y double, rank int")
        if len(self.index.blocks.block) == 1:
            return self.first_found()  # there is no other block to look into
        found = cut_lineage(self.first_found())
        more = self._looked_up(self.round_two(found))
        return self._best(found.drop("rank").unionByName(more))


class _KNNParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol):
    k = Param(Params._dummy(), "k", "number of neighbours", typeConverter=TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "uniform|distance", typeConverter=TypeConverters.toString)
    metric = Param(Params._dummy(), "metric", "euclidean|manhattan", typeConverter=TypeConverters.toString)
    blockRows = Param(Params._dummy(), "blockRows", "rows per block", typeConverter=TypeConverters.toInt)
    approxRecall = Param(Params._dummy(), "approxRecall", "0: exact; else the share of the true neighbours that the "
                         "approximate search (euclidean) is tuned to find", typeConverter=TypeConverters.toFloat)
    idCol = Param(Params._dummy(), "idCol", "unique long id of training rows (tie-break); generated if unset",
                  typeConverter=TypeConverters.toString)
    queryIdCol = Param(Params._dummy(), "queryIdCol", "unique id of rows to score; generated (and checkpointed) "
                       "if unset or absent", typeConverter=TypeConverters.toString)

    def _defaults(self):
        self._setDefault(k=5, weights="uniform", metric="euclidean", blockRows=DEFAULT_BLOCK_ROWS, approxRecall=0.0,
                         featuresCol="features", labelCol="label", predictionCol="prediction",
                         probabilityCol="probability")


class KNN(Estimator, _KNNParams):
    @keyword_only
    def __init__(self, k=5, weights="uniform", metric="euclidean", blockRows=DEFAULT_BLOCK_ROWS,
                 featuresCol="features", labelCol="label", predictionCol="prediction", probabilityCol="probability",
                 idCol=None, queryIdCol=None, approxRecall=0.0):
        super().__init__()
        self._defaults()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> "KNNModel":
        tid = (F.col(self.getOrDefault(self.idCol)).cast("long") if self.isSet(self.idCol)
               else F.monotonically_increasing_id())
        train = df.select(vector_to_array(F.col(self.getFeaturesCol())).alias("x"),
                          F.col(self.getLabelCol()).cast("double").alias("y"), tid.alias("tid"))
        train = spread(cut_lineage(train))  # the model's training table; generated ids stay fixed on recomputation
        classes = [r[0] for r in train.select("y").distinct().orderBy("y").collect()]  # one row per class
        m = KNNModel(train, classes)
        return self._copyValues(m)


class KNNModel(Model, _KNNParams):
    def __init__(self, train: DataFrame | None = None, classes: list | None = None):
        super().__init__()
        self._defaults()
        self.train = train
        self.classes = classes or []
        self._index: PivotIndex | None = None
        self._buckets = None
        self._found: tuple | None = None

    def neighbours(self, df: DataFrame, id_col: str) -> DataFrame:
        """(qid, rank, tid, dist, y) of the k nearest training rows per test row."""
        recall = self.getOrDefault(self.approxRecall)
        if not recall:
            return self._exact(df, id_col)
        if self.getOrDefault(self.metric) != "euclidean":
            raise ValueError("the approximate search is for the euclidean metric")
        if self._buckets is None or self._buckets.target != recall:
            from .knn_lsh import BucketIndex
            self._buckets = BucketIndex(self.train, recall, self.getOrDefault(self.k), self.getOrDefault(self.blockRows))
        return self._buckets.neighbours(self._queries(df, id_col), self.getOrDefault(self.k),
                                        lambda rows: self.search(rows, "qid", ready=True).neighbours())

    def _exact(self, df: DataFrame, id_col: str) -> DataFrame:
        """The search's result, kept for a second use on the same rows: (qid, tid, dist, y, rank), k rows a query."""
        asked = self._queries(df, id_col)
        how = self.getOrDefault(self.k), self.getOrDefault(self.metric), id_col
        if self._found is None or self._found[0] != how or not self._found[1].sameSemantics(asked):
            self._found = how, asked, cut_lineage(self.search(df, id_col).neighbours())
        return self._found[2]

    def _queries(self, df: DataFrame, id_col: str) -> DataFrame:
        return df.select(F.col(id_col).alias("qid"), vector_to_array(F.col(self.getFeaturesCol())).alias("x"))

    def search(self, df: DataFrame, id_col: str, ready: bool = False) -> "PivotSearch":
        metric = self.getOrDefault(self.metric)
        if self._index is None or self._index.metric != metric:
            self._index = PivotIndex(self.train, metric, self.getOrDefault(self.blockRows))
        return PivotSearch(self._index, df if ready else self._queries(df, id_col), self.getOrDefault(self.k))

    def _transform(self, df: DataFrame) -> DataFrame:
        if self.isSet(self.queryIdCol) and self.getOrDefault(self.queryIdCol) in df.columns:
            id_col, base = self.getOrDefault(self.queryIdCol), df   # the caller's unique row id
        else:
            id_col = "_knn_row"
            # generated ids must survive recomputation: freeze them once
            base = cut_lineage(df.withColumn(id_col, F.monotonically_increasing_id()))
        nb = self.neighbours(base, id_col)
        if self.getOrDefault(self.weights) == "distance":
            has_zero = F.max(F.when(F.col("dist") == 0, 1).otherwise(0)).over(Window.partitionBy("qid"))
            w = F.when(has_zero == 1, F.when(F.col("dist") == 0, 1.0).otherwise(0.0)).otherwise(1.0 / F.col("dist"))
        else:
            w = F.lit(1.0)
        votes = nb.withColumn("w", w).groupBy("qid", "y").agg(F.sum("w").alias("w"))
        totals = votes.groupBy("qid").agg(
            F.sum("w").alias("tw"),
            F.max_by("y", F.struct(F.col("w"), -F.col("y"))).alias("pred"),
            F.map_from_entries(F.collect_list(F.struct("y", "w"))).alias("vw"))  # at most k entries
        probs = array_to_vector(F.array(*[F.coalesce(F.col("vw")[F.lit(c)], F.lit(0.0)) / F.col("tw")
                                          for c in self.classes]))
        scored = totals.select(F.col("qid").alias(id_col), F.col("pred").alias(self.getPredictionCol()),
                               probs.alias(self.getProbabilityCol()))
        out = base.join(scored, id_col, "left")
        return out.drop(id_col) if id_col == "_knn_row" else out
