"""Trees grown from counts: those of Spark's fits, whatever is counted in one pass."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tablesmith.operators import fold_trees as FT
from tablesmith.operators import grown_trees as G
from tablesmith.operators import tuning as H
from tablesmith.operators.models import catalogue as M


def labelled(spark, n=900):
    """Few distinct values, so that no sample decides on a threshold."""
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, n)
    x = np.round((rng.normal(size=(n, 4)) + y[:, None] * [0.8, 0.5, 0.0, 0.2]) * 3)
    return spark.createDataFrame([(i, float(c), Vectors.dense(v)) for i, (c, v) in enumerate(zip(y.tolist(), x.tolist()))],
                                 ["id", "label", "features"])


@pytest.fixture
def large(monkeypatch):
    monkeypatch.setattr(G, "GROWN_ROWS", 0)


def test_fold_counts_equal_single_fits(spark, monkeypatch):
    data = H.with_folds(labelled(spark), 3, key=["id"]).cache()
    combos = [{"max_depth": d, "min_samples_leaf": m} for d in (2, 4) for m in (5, 60)]
    counts = H._training_counts(data, 3)
    want = FT.tree_counts("Rule-Based", data, combos, counts)
    monkeypatch.setattr(G, "GROWN_ROWS", 0)
    monkeypatch.setattr(G, "CELLS", 2000)       # several passes a level
    monkeypatch.setattr(G, "CHUNK_ROWS", 50)
    assert sorted(FT.tree_counts("Rule-Based", data, combos, counts)) == sorted(want)


def test_large_rule_search_fits_once(spark, monkeypatch, large):
    fits = []
    one = M.train_one
    monkeypatch.setattr(M, "train_one", lambda *a, **kw: fits.append(a) or one(*a, **kw))
    grid = {"max_depth": [2, 3], "min_samples_leaf": [5, 20]}
    H.grid_search("Rule-Based", labelled(spark, 300), grid=grid, key=["id"], folds=3)
    assert len(fits) == 1  # the refit


def test_single_tree_is_sparks(spark, monkeypatch):
    train = labelled(spark)
    spark_tree = M.train_one("Rule-Based", train).model
    monkeypatch.setattr(G, "GROWN_ROWS", 0)
    grown = M.train_one("Rule-Based", train).model
    assert grown.toDebugString.splitlines()[1:] == spark_tree.toDebugString.splitlines()[1:]
    assert np.allclose(grown.featureImportances.toArray(), spark_tree.featureImportances.toArray())


def test_thresholds_halve_distinct_values_and_weigh_rows():
    assert G.thresholds(np.array([1.0, 2.0, 2.0, 4.0]), np.ones(4)).tolist() == [1.5, 3.0]
    values = np.arange(1000.0)
    even = G.thresholds(values, np.ones(1000))
    assert len(even) == 31 and np.all(np.abs(np.diff(even) - 1000 / 32) <= 1)
    assert np.median(G.thresholds(values, np.where(values < 500, 9.0, 1.0))) < 300  # half of the weight lies low


def test_forest_is_a_bagged_one(spark, large):
    train = labelled(spark)
    trained = M.train_one("Random Forest", train, {"n_estimators": 30, "max_depth": 4, "min_samples_leaf": 10})
    model = trained.model
    assert type(model).__name__ == "RandomForestClassificationModel" and model.getNumTrees == 30
    sizes = [int(t._call_java("rootNode").impurityStats().rawCount()) for t in model.trees]
    assert abs(np.mean(sizes) - 900) < 30 and 10 < np.std(sizes) < 60      # Poisson bags of 900 rows: 30
    roots = {t._call_java("rootNode").split().featureIndex() for t in model.trees if t.depth}
    assert len(roots) > 1                                                   # two of four features a node
    want = model.transform(train).select("id", "probability", F.col("prediction").alias("p"))
    for r in M.predict(trained, train).drop("probability").withColumnRenamed("rawPrediction", "raw").join(want, "id").collect():
        assert r["p"] == r["prediction"] and np.allclose(r["raw"].toArray() / 30, r["probability"].toArray())
    again = M.train_one("Random Forest", train, {"n_estimators": 30, "max_depth": 4, "min_samples_leaf": 10}).model
    assert again.toDebugString.split("\n", 1)[1] == model.toDebugString.split("\n", 1)[1]


def test_bag_sizes_are_poisson():
    share = np.bincount(G.BAG, minlength=4)[:4] / len(G.BAG)
    assert np.allclose(share, np.exp(-1) / np.array([1, 1, 2, 6]), atol=1e-4) and abs(G.BAG.mean() - 1) < 1e-3


def test_values_that_are_no_numbers_are_refused(spark, large):
    bad = labelled(spark, 200).union(spark.createDataFrame([(999, 1.0, Vectors.dense([float("nan"), 1.0, 2.0, 3.0]))]))
    with pytest.raises(Exception, match="finite"):
        M.train_one("Rule-Based", bad)


def test_positions_are_dealt_alike_by_either_join(spark, monkeypatch):
    train = labelled(spark, 300)
    sent = H.with_folds(train, 5, key=["id"], plain_rows=0)
    monkeypatch.setattr(H, "SENT_STARTS", 0)
    joined = H.with_folds(train, 5, key=["id"], plain_rows=0)
    plain = H.with_folds(train, 5, key=["id"])
    folds = [{r["id"]: r["fold"] for r in t.collect()} for t in (sent, joined, plain)]
    assert folds[0] == folds[1] == folds[2] and len(folds[0]) == 300
