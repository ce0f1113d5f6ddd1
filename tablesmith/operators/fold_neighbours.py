"""Cross-validated k-NN from one neighbour table (H2, H3).

For every metric, one exact search finds the nearest rows of all folds for every row, more than
the largest k of the search wants. The first k entries outside a fold are the row's neighbours for that fold: rows
of the fold are its test side, the others the training side. A row whose list holds too few
entries outside a fold (its neighbours crowd in it) is searched again against the rows outside that fold. All
combinations of k and weights are votes over the first k entries, counted batch by batch, so a grid of any size
costs one search per metric.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bounded
from ..session import cut_lineage
from .fold_stats import MAX_COUNTS
from .models.knn import KNN


def votes(classes: np.ndarray, found: np.ndarray, dist: np.ndarray, k: int, weights: str) -> np.ndarray:
    """Index of the class with most votes of the first k entries (columns) of each row; an absent entry has class -1.
    The smaller class wins a tie; with distance weights entries at distance 0 are the only ones that count, if any."""
    found, dist = found[:, :k], dist[:, :k]
    weight = (found >= 0).astype(float)
    if weights == "distance":
        zero = (dist == 0) & (found >= 0)
        with np.errstate(divide="ignore"):
            weight = np.where(zero.any(axis=1)[:, None], zero, weight / np.where(dist == 0, np.inf, dist))
    score = np.zeros((len(found), len(classes)))
    rows = np.arange(len(found))
    for j in range(found.shape[1]):  # an absent entry adds nothing to the last class
        score[rows, found[:, j]] += weight[:, j]
    return score.argmax(axis=1)


def wider(k: int) -> int:
    """Entries of a row's list: the k wanted outside a fold and room for its own."""
    return 2 * k + 10


def outside(fold: int) -> Column:
    """The entries of a list that are not of ``fold``."""
    return F.filter("near", lambda e: e["at"] != fold)


def entries(near: Column) -> Column:
    return F.transform(near, lambda e: F.struct(e["dist"].alias("dist"), e["y"].alias("y")))


def neighbour_table(data: DataFrame, k: int, metric: str, classes: np.ndarray, folds: int) -> DataFrame:
    """(qid, y, fold, near array<struct<rank,dist,y,at>>): the k nearest rows of every row, of its own and other folds.
    Class and fold of a training row go through the search as one number."""
    values = F.array(*[F.lit(float(c)) for c in classes])
    code = (F.array_position(values, F.col("label")) - 1) * folds + F.col("fold")
    model = KNN(k=k, metric=metric, idCol="tid").fit(data.withColumn("label", code.cast("double")))
    near = model.neighbours(data, "tid").select(
        "qid", "rank", "dist", F.get(values, F.floor(F.col("y") / folds).cast("int")).alias("y"),
        F.pmod(F.col("y"), F.lit(folds)).cast("int").alias("at")).groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("rank", "dist", "y", "at"))).alias("near"))  # at most k entries
    return data.select(F.col("tid").alias("qid"), F.col("label").cast("double").alias("y"), "fold").join(near, "qid")


def _outside(data: DataFrame, asked: DataFrame, fold: int, k: int, metric: str) -> DataFrame:
    """(y, fold, near) of the rows of ``asked`` (qid): their k nearest rows outside ``fold``."""
    model = KNN(k=k, metric=metric, idCol="tid").fit(data.where(F.col("fold") != fold))
    rows = data.join(asked.select(F.col("qid").alias("tid")).distinct(), "tid")
    near = model.neighbours(rows, "tid").groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("rank", "dist", "y"))).alias("near"))
    return rows.select(F.col("tid").alias("qid"), F.col("label").cast("double").alias("y"), "fold").join(near, "qid")


def knn_counts(data: DataFrame, combos: list[dict], folds: int, with_train: bool = True, id_col: str | None = None,
               parallelism: int = 4) -> list[tuple[int, int, bool, float, float, int]]:
    """(combination, fold, on the test side, class, predicted class, rows). ``combos`` have n_neighbors, weights
    and metric; ``id_col`` is a unique long that settles equal distances (generated if not given)."""
    tid = F.col(id_col).cast("long") if id_col else F.monotonically_increasing_id()
    data = cut_lineage(data.select("features", F.col("label").cast("double").alias("label"), "fold", tid.alias("tid")))
    classes = np.array(sorted(r[0] for r in bounded(data.select("label").distinct(), "classes")))

    used = sorted(r[0] for r in data.select("fold").distinct().collect())  # folds that hold rows

    def counted(metric: str) -> list[tuple]:
        mine = [(i, int(c["n_neighbors"]), c["weights"]) for i, c in enumerate(combos) if c["metric"] == metric]
        k_max = max(k for _, k, _ in mine)
        wide = wider(k_max)
        table = cut_lineage(neighbour_table(data, wide, metric, classes, max(used) + 1))
        # a list that is not full holds every row
        short = {f: (F.size("near") >= wide) & (F.size(outside(f)) < k_max) for f in used}
        lacking = table.agg(*[F.count(F.when(c, 1)).alias(str(f)) for f, c in short.items()]).first().asDict()
        again = {f: cut_lineage(_outside(data, table.where(short[f]), f, k_max, metric)) for f in used if lacking.get(str(f))}

        def votes_of(fold: int):
            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    if batch.empty:
                        continue
                    found = np.full((len(batch), k_max), -1)
                    dist = np.full((len(batch), k_max), np.inf)
                    for r, near in enumerate(batch["near"]):
                        found[r, :len(near)] = np.searchsorted(classes, [e["y"] for e in near])
                        dist[r, :len(near)] = [e["dist"] for e in near]
                    out = [pd.DataFrame({"combo": i, "test": batch["fold"] == fold, "y": batch["y"],
                                         "p": classes[votes(classes, found, dist, k, weights)]}) for i, k, weights in mine]
                    yield pd.concat(out).groupby(["combo", "test", "y", "p"]).size().reset_index(name="n")
            return run

        rows = []
        for f in used:
            done = table.where(~short[f]) if f in again else table
            lists = done.select("y", "fold", entries(F.slice(outside(f), 1, k_max)).alias("near"))
            if f in again:
                lists = lists.union(again[f].select("y", "fold", entries(F.col("near")).alias("near")))
            lists = lists if with_train else lists.where(F.col("fold") == f)
            counts = lists.where(F.size("near") > 0).mapInPandas(
                votes_of(f), "combo int, test boolean, y double, p double, n long").groupBy(
                "combo", "test", "y", "p").agg(F.sum("n").alias("n"))
            rows += [(r["combo"], f, r["test"], r["y"], r["p"], r["n"])
                     for r in bounded(counts, "classes x classes x models", MAX_COUNTS)]
        return rows

    jobs = sorted({c["metric"] for c in combos}) if len(used) > 1 else []
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        return [row for rows in pool.map(counted, jobs) for row in rows]
