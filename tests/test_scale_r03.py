"""Work of large tables: spread over tasks, shared between the combinations of a search, in cheap arithmetic first."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tablesmith.operators import tuning as H
from tablesmith.operators.models import catalogue as M
from tablesmith.operators.models import knn as K
from tablesmith.session import cut_lineage, spread


def labelled(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    x = rng.normal(size=(n, 3)) + y[:, None] * [0.8, 0.5, 0.0]
    return spark.createDataFrame([(i, float(c), Vectors.dense(v)) for i, (c, v) in enumerate(zip(y.tolist(), x.tolist()))],
                                 ["id", "label", "features"])


def test_one_partition_is_spread(spark):
    one = cut_lineage(spark.range(1000).coalesce(1))
    dealt = spread(one, rows_per_task=250, small_rows=100)
    assert one.rdd.getNumPartitions() == 1 and dealt.rdd.getNumPartitions() == 4
    assert sorted(r.id for r in dealt.collect()) == list(range(1000))
    assert spread(one) is one  # a small table stays as it is


def test_prepared_rows_are_spread(spark, monkeypatch):
    from tablesmith import session
    from tablesmith.operators import prepare as T
    monkeypatch.setattr(T, "spread", lambda df: session.spread(df, 50, 10))
    df = spark.range(400).select("id", (F.col("id") % 3).alias("y"), (F.col("id") * 1.5).alias("x")).coalesce(1)
    prep = T.prepare(df, T.PrepConfig(target="y", features=("x",), key=("id",)), keep=["id"])
    assert prep.train.rdd.getNumPartitions() >= 4 and prep.train.count() == 320 and prep.test.count() == 80


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("kind", ["far", "ties", "nan", "huge"])
def test_rough_distances_lose_no_neighbour(metric, kind):
    rng = np.random.default_rng(1)
    rows, points = rng.normal(size=(400, 7)), rng.normal(size=(50, 7))
    if kind == "far":
        rows, points = rows * 1e-3 + 1e6, points * 1e-3 + 1e6
    if kind == "ties":
        rows, points = np.round(rows), np.round(points)
    if kind == "nan":
        rows[::9, 2], points[3, 1] = np.nan, np.inf
    if kind == "huge":
        rows, points = rows * 1e120, points * 1e120
    tids = rng.permutation(400)
    exact = K.distances(points, rows, metric)
    limit = np.where(np.arange(50) % 2 == 0, np.inf, np.nan_to_num(np.nanquantile(exact, 0.01, axis=1), posinf=1.0))
    got = [np.concatenate(c) for c in zip(*K.nearest_rows(points, rows, tids, limit, 6, metric))]
    want = [(q, t, d) for q in range(50) for d, t in sorted((d, t) for d, t in zip(exact[q], tids) if d <= limit[q])[:6]]
    assert list(zip(got[0].tolist(), tids[got[1]].tolist(), got[2].tolist())) == want


def test_trees_of_all_depths_equal_single_fits(spark):
    train = labelled(spark, 600)
    data = H.with_folds(train, 5, key=["id"]).cache()
    combos = [{"max_depth": d, "min_samples_leaf": m} for d in (0, 2, 4) for m in (5, 20)]
    shared = H._rules_search(data, combos, 5, True, ["id"], 4)
    single = H._fit_every("Rule-Based", data, combos[2:], 5, 4, True)
    got = {(str(p), f): (s, t) for p, f, s, t in shared}
    assert len(got) == 30
    for p, f, s, t in single:
        assert np.allclose(got[str(p), f], (s, t))


def test_tree_searches_fit_once_for_all_depths(spark, monkeypatch):
    fits = []
    one = M.train_one
    monkeypatch.setattr(M, "train_one", lambda *a, **kw: fits.append(a) or one(*a, **kw))
    grid = {"max_depth": [1, 2, 3], "min_samples_leaf": [5]}
    H.grid_search("Rule-Based", labelled(spark, 200), grid=grid, key=["id"], folds=3)
    assert len(fits) == 3 + 1  # one a fold, and the refit


def test_folds_of_large_classes_equal_those_of_small_ones(spark):
    t = labelled(spark, 500).withColumn("label", F.when(F.col("id") % 50 > 0, F.col("label")))
    t = t.union(t.where(F.col("id") < 7))
    small, large = H.with_folds(t, 5, key=["id"]), H.with_folds(t, 5, key=["id"], plain_rows=3)
    assert small.columns == large.columns
    def rows(d):
        return sorted((r.id, -1 if r.label is None else r.label, r.fold) for r in d.collect())
    assert rows(small) == rows(large)


def test_knn_search_where_a_fold_crowds_around_a_row(spark):
    """Fifty copies in one fold fill the lists of their neighbours: those are searched again."""
    from tablesmith.operators.fold_neighbours import knn_counts
    rng = np.random.default_rng(3)
    x = np.concatenate([np.zeros((50, 2)), rng.normal(size=(70, 2))])
    fold = np.concatenate([np.zeros(50, dtype=int), rng.integers(0, 3, 70)])
    y = rng.integers(0, 2, 120).astype(float)
    data = spark.createDataFrame([(i, float(y[i]), int(fold[i]), Vectors.dense(x[i])) for i in range(120)],
                                 ["id", "label", "fold", "features"])
    combos = [{"n_neighbors": k, "weights": "uniform", "metric": m} for k in (3, 5) for m in ("euclidean", "manhattan")]
    want = {}
    for i, c in enumerate(combos):
        d = K.distances(x, x, c["metric"])
        for f in range(3):
            out = np.flatnonzero(fold != f)
            for q in range(120):
                near = out[np.lexsort((out, d[q, out]))[:c["n_neighbors"]]]
                p = float(np.bincount(y[near].astype(int), minlength=2).argmax())
                cell = (i, f, bool(fold[q] == f), y[q], p)
                want[cell] = want.get(cell, 0) + 1
    got = {(i, f, t, a, p): n for i, f, t, a, p, n in knn_counts(data, combos, 3, True, "id")}
    assert got == want


def test_large_svm_fits_one_class_at_a_time(spark, monkeypatch):
    """Each class's fit caches a copy of the projected table; the result does not depend on how many run at once."""
    taken, real = [], M.OneVsRest
    monkeypatch.setattr(M, "OneVsRest", lambda **kw: taken.append(kw["parallelism"]) or real(**kw))
    train = cut_lineage(labelled(spark, 90).coalesce(1))
    params = {"components": 4, "max_iter": 3}
    together = M.train_one("Support Vector Machine", train, params).model.transform(train)
    monkeypatch.setattr(M, "FITS_TOGETHER_BYTES", 1)
    alone = M.train_one("Support Vector Machine", train, params).model.transform(train)
    assert taken == [3, 1]
    assert [r.prediction for r in together.orderBy("id").collect()] == [r.prediction for r in alone.orderBy("id").collect()]


def test_spearman_shuffles_rows_only_for_columns_of_many_values(spark, monkeypatch):
    import pandas as pd

    from tablesmith.operators import correlation as C
    rng = np.random.default_rng(5)
    rows = [(float(i), float(rng.integers(0, 40)), float(rng.integers(0, 7)), float(rng.integers(0, 60))) for i in range(500)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    seen, pearson_pairs = [], C._pearson_pairs

    def keep(ranked, *args, **kwargs):
        seen.append(ranked._jdf.queryExecution().executedPlan().toString())
        return pearson_pairs(ranked, *args, **kwargs)
    monkeypatch.setattr(C, "_pearson_pairs", keep)
    want = pd.DataFrame(rows).corr(method="spearman")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for values, most, joins in ((2_000_000, 2_000_000, 0), (300, 2_000_000, 1), (0, 2_000_000, 4), (2_000_000, 30, 3)):
            monkeypatch.setattr(C, "BROADCAST_VALUES", values, raising=False)
            for r in C.spearman(df, max_task_rows=most).collect():
                assert abs(r["r"] - want.iloc[r["idx_1"], r["idx_2"]]) < 6e-4
            assert seen.pop().count("SortMergeJoin") == joins
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
