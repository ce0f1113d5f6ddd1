"""M2, approximate option: k nearest neighbours (euclidean) by Spark ML's BucketedRandomProjectionLSH.

Every row gets ``TABLES`` keys, each made of ``PROJECTIONS`` buckets of random projections; a query is compared with
the rows that share a key with it. The bucket length is tuned to a wanted recall instead of being guessed: the true
neighbours of at most ``SAMPLE`` training rows (those of the smallest id hashes) are found by one pass over all rows;
the smallest length whose expected share of them is high enough starts the search, and it is widened until
the fitted model really puts that share of them under a common key (``recall``).

A key is split into chunks of at most ``blockRows`` rows and a chunk's queries into blocks of as many, so a key that
holds a third of all rows costs many bounded tasks; a task emits the k best of each query, never its pairs. Queries that
meet fewer than k rows are answered by the exact search, so every query gets min(k, rows) neighbours.

On vectors without structure only wide buckets reach a high recall, and the work comes near that of the exact search
(``candidate_share`` tells).

Defined results: of equal distances the smaller id wins; an empty training table gives no neighbours; fewer rows than
k give all of them; repeated rows are rows of their own; of columns only the ids and vectors are read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...session import cut_lineage
from .knn import DEFAULT_BLOCK_ROWS, _matrix, _steps, best, distances, looked_up

TABLES = 6
PROJECTIONS = 2
SAMPLE = 256
DRAWS = 1024
WIDER = 1.25
ROUNDS = 40
SEED = 42


def common_key(dist: np.ndarray, length: float, draws: np.ndarray) -> np.ndarray:
    """Chance that two rows at each distance share a key of some table: with |c| the part of a difference that lies
    along a random direction, a bucket of that length keeps both with chance 1 - |c| dist / length."""
    one = np.maximum(0.0, 1.0 - np.outer(dist, np.abs(draws)) / length).mean(axis=1)
    return 1.0 - (1.0 - one ** PROJECTIONS) ** TABLES


class BucketIndex:
    """Training rows (tid, x, y) by their keys.

    ``recall`` is the measured share of the sample's true neighbours that share a key with their query, ``length`` the
    bucket length."""

    def __init__(self, train: DataFrame, target: float, k: int, block_rows: int = DEFAULT_BLOCK_ROWS):
        if not 0 < target < 1:
            raise ValueError("the wanted recall must be between 0 and 1")
        self.target, self.block_rows, self.train = target, block_rows, train
        self.total = train.count()
        self.recall, self.length, self.model = 1.0, 1.0, None
        if not self.total:
            return
        sample = train.select("tid", "x").orderBy(F.xxhash64("tid"), "tid").limit(SAMPLE).toPandas()
        points = _matrix(sample["x"])
        pairs = self._true_neighbours(sample, points, k)
        dim = points.shape[1]
        rng = np.random.default_rng(SEED)
        directions = rng.normal(size=(DRAWS, dim))
        draws = directions[:, 0] / np.linalg.norm(directions, axis=1)
        dist = pairs["dist"].to_numpy(dtype=float)
        spread = float(dist.max()) if len(dist) else 0.0
        low, high = 0.0, max(spread, 1e-9) * 1e4
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (low, middle) if not len(dist) or common_key(dist, middle, draws).mean() >= target else (middle, high)
        self.length = high
        # Spark's buckets all have a border at 0, where centred data lie; moving every vector by the same one does
        # not change a distance and gives each projection an offset of its own
        offset = rng.normal(size=dim)
        self.offset = (offset / np.linalg.norm(offset)).tolist()
        for _ in range(ROUNDS):
            self.model = self._fit(dim)
            self.recall = self._measured(sample, pairs)
            if self.recall >= target:
                break
            self.length *= WIDER
        else:
            raise ValueError(f"no bucket length reaches a recall of {target}: {self.recall} at {self.length}")
        keyed = self._keyed(train.select("tid", "x", "y"))
        sizes = cut_lineage(keyed.groupBy("key").count())
        self.parts = sizes.where(F.col("count") > block_rows).select(
            F.col("key").alias("big"), F.ceil(F.col("count") / block_rows).cast("int").alias("parts"))
        chunk = F.pmod(F.xxhash64("tid"), F.coalesce("parts", F.lit(1))).cast("int")
        self.rows = keyed.join(self.parts, F.col("key") == F.col("big"), "left").select(
            "x", "y", "tid", F.xxhash64("key", chunk).alias("block"))

    def _true_neighbours(self, sample: pd.DataFrame, points: np.ndarray, k: int) -> pd.DataFrame:
        """(q, tid, dist, x): the k nearest other rows of each sampled row, by one pass over all rows."""
        ids = sample["tid"].to_numpy()

        def nearest(batches):
            held = pd.DataFrame({"q": [], "tid": [], "dist": [], "x": []})
            for batch in batches:
                if batch.empty:
                    continue
                x, tid = _matrix(batch["x"]), batch["tid"].to_numpy()
                for part in _steps(x, points):
                    d = distances(x[part], points, "euclidean").T
                    d[ids[:, None] == tid[part][None, :]] = np.inf
                    near = np.argsort(d, axis=1, kind="stable")[:, :k]
                    row = np.repeat(np.arange(len(ids)), near.shape[1])
                    new = pd.DataFrame({"q": ids[row], "tid": tid[part][near.ravel()], "dist": d[row, near.ravel()],
                                        "x": list(x[part][near.ravel()])})
                    held = pd.concat([held, new[np.isfinite(new["dist"])]]) if len(held) else new[np.isfinite(new["dist"])]
                    held = held.sort_values(["dist", "tid"]).groupby("q").head(k)
            if len(held):
                yield held

        found = self.train.select("tid", "x").mapInPandas(nearest, "q long, tid long, dist double, x array<double>")
        return best(found.withColumnRenamed("q", "qid"), k).toPandas()  # SAMPLE * k rows at most

    def _fit(self, dim: int):
        lsh = BucketedRandomProjectionLSH(inputCol="_moved", outputCol="_hashes", bucketLength=self.length,
                                          numHashTables=TABLES * PROJECTIONS, seed=SEED)
        one = self.train.sparkSession.createDataFrame([([0.0] * dim,)], "x array<double>")
        return lsh.fit(one.select(array_to_vector("x").alias("_moved")))  # the directions depend on seed and size only

    def _keyed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with column key: one row per table."""
        away = self.length * 1000 * len(self.offset) ** 0.5
        moved = F.zip_with("x", F.array(*[F.lit(o * away) for o in self.offset]), lambda a, b: a + b)
        hashed = self.model.transform(rows.withColumn("_moved", array_to_vector(moved)))
        return hashed.select(*rows.columns, F.explode(keys_of(F.col("_hashes"))).alias("key"))

    def _measured(self, sample: pd.DataFrame, pairs: pd.DataFrame) -> float:
        """Share of the sampled rows' true neighbours that share a key with them."""
        if pairs.empty:
            return 1.0
        spark = self.train.sparkSession
        asked = spark.createDataFrame(
            [(int(t), [float(v) for v in x]) for t, x in zip(sample["tid"], sample["x"])], "qid long, x array<double>")
        wanted = spark.createDataFrame(
            [(int(q), int(t), [float(v) for v in x]) for q, t, x in zip(pairs["qid"], pairs["tid"], pairs["x"])],
            "qid long, tid long, x array<double>")
        both = self._keyed(wanted).join(self._keyed(asked).select("qid", "key"), ["qid", "key"])
        return both.select("qid", "tid").distinct().count() / len(pairs)

    def routed(self, queries: DataFrame) -> DataFrame:
        """(qid, x, limit, qb, block): the chunks each query looks into."""
        keyed = self._keyed(queries.select("qid", "x")).dropDuplicates(["qid", "key"])
        counts = keyed.groupBy("key").count().where(F.col("count") > self.block_rows).select(
            F.col("key").alias("asked"), F.ceil(F.col("count") / self.block_rows).cast("int").alias("q_parts"))
        dealt = keyed.join(self.parts, F.col("key") == F.col("big"), "left").join(
            counts, F.col("key") == F.col("asked"), "left")
        chunks = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("chunk")
        qb = F.pmod(F.xxhash64("qid"), F.coalesce("q_parts", F.lit(1))).alias("qb")
        return dealt.select("qid", "x", F.lit(float("inf")).alias("limit"), qb, "key", chunks).select(
            "qid", "x", "limit", "qb", F.xxhash64("key", "chunk").alias("block"))

    def candidate_share(self, queries: DataFrame) -> float:
        """Compared (query, row) pairs, repeats over tables included, as a share of all pairs."""
        sizes = self.rows.groupBy("block").count()
        pairs = self.routed(queries).join(sizes, "block").agg(F.sum("count")).first()[0] or 0
        return pairs / max(1, self.total * queries.count())

    def neighbours(self, queries: DataFrame, k: int, exact: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """(qid, tid, dist, y, rank); ``exact`` answers the queries that met fewer than min(k, rows) rows."""
        qtype = queries.schema["qid"].dataType.simpleString()
        if not self.total:
            return queries.sparkSession.createDataFrame([], f"qid {qtype}, tid long, dist double, y double, rank int")
        met = looked_up(self.routed(queries), self.rows, k, "euclidean", qtype)
        met = met.groupBy("qid", "tid").agg(F.min("dist").alias("dist"), F.first("y").alias("y"))  # met in several tables
        found = cut_lineage(best(met, k))
        full = found.groupBy("qid").count().where(F.col("count") >= min(k, self.total)).select("qid")
        short = cut_lineage(queries.join(full, "qid", "left_anti"))
        if short.isEmpty():
            return found
        return found.join(full, "qid", "left_semi").unionByName(exact(short))


def keys_of(hashes):
    """The distinct keys of a row: table number and its buckets in 64 bits. Two keys that fall together only add rows
    to compare."""
    per_table = [F.xxhash64(F.lit(t), *[F.get(vector_to_array(F.get(hashes, F.lit(t * PROJECTIONS + p))), F.lit(0))
                                        for p in range(PROJECTIONS)]) for t in range(TABLES)]
    return F.array_distinct(F.array(*per_table))
