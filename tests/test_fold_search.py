"""Searches whose combinations share their passes over the data."""

import numpy as np
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tablesmith.operators import fold_stats as FS
from tablesmith.operators import tuning as H
from tablesmith.operators.evaluate import weighted_f1
from tablesmith.operators.models.naive_bayes import GaussianNB


def labelled(spark, n=400, classes=3, dim=3, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    x = rng.normal(size=(n, dim)) * [1, 10, 1000][:dim] + y[:, None] * [0.8, 5, 300][:dim]
    return spark.createDataFrame([(i, float(c), Vectors.dense(v)) for i, (c, v) in enumerate(zip(y.tolist(), x.tolist()))],
                                 ["id", "label", "features"])


def test_merged_moments_equal_the_whole(spark):
    data = H.with_folds(labelled(spark), 5, key=["id"]).cache()
    moments = FS.fold_moments(data)
    for fold in range(5):
        model = FS.FoldModel.of(moments, fold)
        x = {}
        for r in data.where(F.col("fold") != fold).collect():
            x.setdefault(r["label"], []).append(r["features"].toArray())
        assert model.classes.tolist() == sorted(x)
        for i, y in enumerate(sorted(x)):
            assert np.allclose(model.mean[i], np.mean(x[y], axis=0)) and np.allclose(model.var[i], np.var(x[y], axis=0))
        assert np.isclose(model.top_var, np.var(np.concatenate(list(x.values())), axis=0).max())


def test_search_equals_single_fits(spark):
    train = labelled(spark)
    res = H.grid_search("Naive Bayes", train, key=["id"])
    data = H.with_folds(train, 5, key=["id"]).cache()
    got = {(r["params"], r["fold"]): (r["test_f1"], r["train_f1"]) for r in res.scores.collect()}
    assert len(got) == 25
    for smoothing in (1e-9, 1e-5):
        for fold in (0, 3):
            model = GaussianNB(varSmoothing=smoothing).fit(data.where(F.col("fold") != fold))
            want = weighted_f1(model.transform(data.where(F.col("fold") == fold))), weighted_f1(
                model.transform(data.where(F.col("fold") != fold)))
            assert np.allclose(got[f'{{"var_smoothing": {smoothing!r}}}', fold], want)


def test_search_reads_the_folds_twice(spark, monkeypatch):
    """One scan for the statistics and one for all scores, whatever the number of combinations."""
    import tablesmith.operators.fold_stats as fs
    taken = []
    monkeypatch.setattr(fs, "bounded", lambda df, what, *a: taken.append(df._jdf.queryExecution().optimizedPlan().toString()) or df.collect())
    data = H.with_folds(labelled(spark, 60), 5, key=["id"])
    fs.naive_bayes_counts(data, [10.0 ** -i for i in range(40)], 5)
    assert len(taken) == 2 and all(p.count("MapInPandas") <= 1 and p.count("Join") == 0 for p in taken)


def test_a_class_that_one_fold_holds_alone(spark):
    rows = [(i, float(i % 2), Vectors.dense([float(i), 1.0])) for i in range(20)] + [(99, 7.0, Vectors.dense([5.0, 2.0]))]
    train = spark.createDataFrame(rows, ["id", "label", "features"])
    scores = H.grid_search("Naive Bayes", train, key=["id"]).scores
    assert scores.count() == 25 and scores.where("test_f1 IS NULL OR isnan(test_f1)").count() == 0


def test_votes():
    from tablesmith.operators.fold_neighbours import votes
    classes = np.array([0.0, 1.0, 2.0])
    found = np.array([[2, 1, 1, 0], [1, 0, -1, -1], [2, 0, 0, 0]])
    dist = np.array([[1.0, 2.0, 4.0, 9.0], [3.0, 3.0, np.inf, np.inf], [0.0, 1.0, 1.0, 1.0]])
    assert votes(classes, found, dist, 1, "uniform").tolist() == [2, 1, 2]
    assert votes(classes, found, dist, 4, "uniform").tolist() == [1, 0, 0]   # a tie goes to the smaller class
    assert votes(classes, found, dist, 4, "distance").tolist() == [2, 0, 2]  # 1 > 3/4; distance 0 counts alone


def test_knn_search_equals_single_fits(spark):
    from tablesmith.operators.models.knn import KNN
    train = labelled(spark, 150)
    grid = {"n_neighbors": [1, 4], "weights": ["uniform", "distance"], "metric": ["manhattan"]}
    got = {(r["params"], r["fold"]): (r["test_f1"], r["train_f1"])
           for r in H.grid_search("K-Nearest Neighbors", train, grid, key=["id"]).scores.collect()}
    assert len(got) == 20
    data = H.with_folds(train, 5, key=["id"]).cache()
    for k, weights in ((1, "uniform"), (4, "distance")):
        model = KNN(k=k, weights=weights, metric="manhattan", idCol="id", queryIdCol="id").fit(data.where("fold <> 2"))
        want = tuple(weighted_f1(model.transform(data.where(c))) for c in ("fold = 2", "fold <> 2"))
        assert np.allclose(got[f'{{"metric": "manhattan", "n_neighbors": {k}, "weights": "{weights}"}}', 2], want)
    part = H.search("K-Nearest Neighbors", train, [{"n_neighbors": 4}], folds=2, with_train_scores=False)
    assert part.scores.where("train_f1 IS NULL AND test_f1 > 0.2").count() == 2
