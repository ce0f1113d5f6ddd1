"""Hyper-parameter tuning (H1-H5): grid and random search with stratified
5-fold cross-validation scored by weighted F1.

Folds: inside each class, rows are ordered by md5(seed | position key) and
dealt round-robin (position mod k) - exact, reproducible and placed inside hash
prefixes, so no class is sorted in one task. Naive Bayes searches
share two passes over the data (``fold_stats``), k-NN searches one neighbour table per
metric (``fold_neighbours``), the rule model one fit for all depths (``fold_trees``; in large tables
the trees of all folds grow in the same passes, ``grown_trees``); of the other models each (params, fold)
fit is an ordinary distributed fit, and ``parallelism`` fits are submitted at once from
driver threads (as ``CrossValidator(parallelism=...)`` does).
The training table is materialised once in the shared checkpoint folder.
"""

from __future__ import annotations

import itertools
import json
import random
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bounded
from ..session import cut_lineage
from .evaluate import metrics_of_pairs, weighted_f1
from .fold_neighbours import knn_counts
from .fold_stats import naive_bayes_counts
from .fold_trees import tree_counts
from .models import catalogue as M
from .ranking import running_totals


def tuning_grid(name: str) -> dict:
    """H1: the model's grid ({} for an unknown model)."""
    spec = M.CATALOGUE.get(name)
    return dict(spec.grid) if spec else {}


def combinations(grid: dict) -> list[dict]:
    keys = list(grid)
    return [dict(zip(keys, vals)) for vals in itertools.product(*[grid[k] for k in keys])]


def estimate_iterations(name: str, method: str = "grid", n_iter: int = 10, folds: int = 5) -> int:
    """H1: fits needed: grid size x folds, or n_iter x folds for random search
    (capped at the grid size, which the reference does not do)."""
    size = len(combinations(tuning_grid(name)))
    return (size if method == "grid" else min(n_iter, size)) * folds


def grid_frame(spark, name: str) -> DataFrame:
    """H1 as a table: one row per parameter combination."""
    rows = [(i, json.dumps(c, sort_keys=True)) for i, c in enumerate(combinations(tuning_grid(name)))]
    return spark.createDataFrame(rows, "combo int, params string")


FOLD_DIGITS = 4     # hash prefixes of 65,536 kinds
PLAIN_ROWS = 100_000
SENT_STARTS = 400_000  # counts by class and prefix sent to all tasks: about 16 MB


def with_folds(train: DataFrame, k: int = 5, seed: int = 42, label: str = "label", key: list[str] | None = None,
               plain_rows: int = PLAIN_ROWS):
    """Stratified fold number 0..k-1 per row. Classes of at most ``plain_rows`` rows are each ordered in one task."""
    key = key or [c for c in train.columns if c not in ("features",)]
    from .prepare import hash_order
    cols = [c for c in key if c != "features"]
    t = train.withColumn("_h", hash_order(seed, cols) if cols else F.lit("")).withColumn("_one", F.lit(1))
    # rows are placed inside their hash prefix; counts by class and prefix tell how many come before
    prefix = F.left("_h", F.lit(FOLD_DIGITS))
    sizes = t.groupBy(F.col(label).alias("_l"), prefix.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_l").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per prefix
    starts = cut_lineage(sizes.select("_l", "_p", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    largest = starts.agg(F.max(F.col("_start") + F.col("_n"))).first()[0] or 0
    if largest <= plain_rows or not cols:
        pos = running_totals(t, [label], ["_h", *cols], ["_one"])
        return pos.withColumn("fold", ((F.col("_one_cum") - 1) % k).cast("int")).drop("_h", "_one", "_one_cum")
    w = Window.partitionBy("_b", label).orderBy("_h", *cols)   # the prefix, which settles most comparisons, first
    placed = t.withColumn("_b", prefix).withColumn("_at", F.row_number().over(w))
    if starts.count() <= SENT_STARTS:
        starts = F.broadcast(starts)
    dealt = placed.join(starts, (F.col("_b") == F.col("_p")) & F.col(label).eqNullSafe(F.col("_l")))
    return dealt.withColumn("fold", ((F.col("_start") + F.col("_at") - 1) % k).cast("int")).select(*train.columns, "fold")


@dataclass
class TuningResult:
    name: str
    best_params: dict
    best_score: float
    scores: DataFrame       # (model, params, fold, test_f1, train_f1)
    best: M.Trained
    seconds: float
    n_iterations: int


def _fit_score(name: str, params: dict, data: DataFrame, fold: int, with_train: bool, counts: dict):
    tr = data.where(F.col("fold") != fold)
    te = data.where(F.col("fold") == fold)
    trained = M.train_one(name, tr.drop("fold"), params, counts=counts)
    test_f1 = weighted_f1(trained.model.transform(te.drop("fold")))
    train_f1 = weighted_f1(trained.model.transform(tr.drop("fold"))) if with_train else None
    return params, fold, test_f1, train_f1


def search(name: str, train: DataFrame, combos: list[dict], folds: int = 5, parallelism: int = 4,
           with_train_scores: bool = True, seed: int = 42, key: list[str] | None = None) -> TuningResult:
    """H2 core: every combination x fold, then refit the best on all of ``train``."""
    t0 = time.time()
    data = cut_lineage(with_folds(train, folds, seed, key=key))
    shared = SHARED_SEARCH.get(name)
    if shared:
        results = shared(data, combos, folds, with_train_scores, key, parallelism)
    else:
        results = _fit_every(name, data, combos, folds, parallelism, with_train_scores)
    return _result(name, train, combos, folds, results, t0)


def _scores(counts: list[tuple], combos: list[dict], folds: int, with_train: bool) -> list[tuple]:
    """(params, fold, test F1, train F1) from (combination, fold, test, class, predicted, rows) counts."""
    pairs: dict[tuple, list] = {}
    for i, f, test, y, p, n in counts:
        pairs.setdefault((i, f, test), []).append((y, p, n))
    return [(combos[i], f, metrics_of_pairs(pairs[i, f, True])["f1"],
             metrics_of_pairs(pairs.get((i, f, False), []))["f1"] if with_train else None)
            for i in range(len(combos)) for f in range(folds) if (i, f, True) in pairs]


def _naive_bayes_search(data: DataFrame, combos: list[dict], folds: int, with_train: bool, key: list[str] | None,
                        parallelism: int) -> list[tuple]:
    """All combinations from one table of fold statistics and one scoring pass."""
    counts = naive_bayes_counts(data, [float(c["var_smoothing"]) for c in combos], folds)
    return _scores(counts, combos, folds, with_train)


def _knn_search(data: DataFrame, combos: list[dict], folds: int, with_train: bool, key: list[str] | None,
                        parallelism: int) -> list[tuple]:
    """All combinations from one neighbour table per metric and fold. A key of one whole-number column is the id
    that settles equal distances."""
    whole = key and len(key) == 1 and dict(data.dtypes)[key[0]] in ("tinyint", "smallint", "int", "bigint")
    full = [M.CATALOGUE["K-Nearest Neighbors"].defaults | c for c in combos]
    return _scores(knn_counts(data, full, folds, with_train, key[0] if whole else None), combos, folds, with_train)


def _rules_search(data: DataFrame, combos: list[dict], folds: int, with_train: bool, key: list[str] | None,
                  parallelism: int) -> list[tuple]:
    """All depths from one fit per fold and leaf size, and one scoring pass."""
    counts = tree_counts("Rule-Based", data, combos, _training_counts(data, folds), parallelism)
    return _scores(counts, combos, folds, with_train)


#: searches in which all combinations share their passes over the data
SHARED_SEARCH = {"Naive Bayes": _naive_bayes_search, "K-Nearest Neighbors": _knn_search, "Rule-Based": _rules_search}


def _training_counts(data: DataFrame, folds: int) -> list[dict]:
    """Class counts of every fold's training side, from one aggregate."""
    cells = [(r["fold"], r["label"], r["n"]) for r in bounded(
        data.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")), "classes x folds")]
    counts = [{} for _ in range(folds)]
    for at, label, n in cells:
        for f in range(folds):
            if f != at:
                counts[f][label] = counts[f].get(label, 0) + n
    return counts


def _fit_every(name: str, data: DataFrame, combos: list[dict], folds: int, parallelism: int, with_train: bool) -> list[tuple]:
    """(params, fold, test F1, train F1) of one fit for every (combination, fold)."""
    jobs = [(p, f) for p in combos for f in range(folds)]
    counts = _training_counts(data, folds)
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        return list(pool.map(lambda j: _fit_score(name, j[0], data, j[1], with_train, counts[j[1]]), jobs))


def _result(name: str, train: DataFrame, combos: list[dict], folds: int, results: list[tuple], t0: float) -> TuningResult:
    """The score table, and the best combination fitted on all of ``train``."""
    spark = train.sparkSession
    rows = [(name, json.dumps(p, sort_keys=True), f, float(s), None if t is None else float(t))
            for p, f, s, t in results]
    scores = spark.createDataFrame(rows, "model string, params string, fold int, test_f1 double, train_f1 double")
    mean = {}
    for p, _, s, _ in results:
        mean.setdefault(json.dumps(p, sort_keys=True), []).append(s)
    order = [json.dumps(p, sort_keys=True) for p in combos]
    best_key = max(order, key=lambda k: (sum(mean[k]) / len(mean[k]), -order.index(k)))
    best_params = json.loads(best_key)
    best = M.train_one(name, train, best_params)
    best.tuned, best.cv_score = True, sum(mean[best_key]) / len(mean[best_key])
    best.seconds = time.time() - t0
    return TuningResult(name, best_params, best.cv_score, scores, best, best.seconds, len(combos) * folds)


def grid_search(name: str, train: DataFrame, grid: dict | None = None, **kw) -> TuningResult:
    """H2: exhaustive search over the model's grid."""
    return search(name, train, combinations(grid or tuning_grid(name)), **kw)


def random_search(name: str, train: DataFrame, n_iter: int = 10, seed: int = 42, grid: dict | None = None,
                  **kw) -> TuningResult:
    """H3: ``n_iter`` combinations drawn without replacement (seeded), capped at
    the grid size."""
    combos = combinations(grid or tuning_grid(name))
    picked = random.Random(seed).sample(combos, min(n_iter, len(combos)))
    return search(name, train, picked, seed=seed, **kw)


def tune_all(train: DataFrame, names: list[str] | None = None, method: str = "random", n_iter: int = 10, **kw):
    """H4: tune each model; failures are returned as (model, error) rows."""
    done, failed = {}, []
    for name in names or list(M.CATALOGUE):
        try:
            done[name] = (grid_search(name, train, **kw) if method == "grid"
                          else random_search(name, train, n_iter, **kw))
        except Exception as e:  # noqa: BLE001
            failed.append((name, f"{type(e).__name__}: {e}"[:500]))
    return done, train.sparkSession.createDataFrame(failed, "model string, error string")


def tuning_table(scores: DataFrame, top: int = 5) -> DataFrame:
    """H5: top combinations by mean test F1, with the std over folds and the
    mean train F1 (4 dp)."""
    g = scores.groupBy("model", "params").agg(F.round(F.avg("test_f1"), 4).alias("mean_score"),
                                              F.round(F.stddev_pop("test_f1"), 4).alias("std_score"),
                                              F.round(F.avg("train_f1"), 4).alias("train_score"))
    return g.orderBy(F.desc("mean_score"), "params").limit(top)
