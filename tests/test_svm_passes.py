"""The SVM of a large table: no projected copy, the solution of the one that keeps it."""

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tablesmith.operators.models import catalogue as M
from tablesmith.operators.models import svm_passes as P


def labelled(spark, n=200):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, n)
    x = rng.normal(size=(n, 3)) + y[:, None] * [1.2, 0.8, 0.0]
    return x, y, spark.createDataFrame([(i, float(c), Vectors.dense(v)) for i, (c, v) in enumerate(zip(y.tolist(), x.tolist()))],
                                       ["id", "label", "features"]).coalesce(2)


def loss(z, y, c, model, n):
    side = np.where(y == c, 1.0, -1.0)
    w = n / (3 * np.bincount(y))[y]
    beta = model.coefficients.toArray()
    return (w * np.maximum(0, 1 - side * (z @ beta + model.intercept))).sum() / w.sum() + beta @ beta / (2 * n)


def test_passes_reach_the_loss_of_sparks_fit(spark, monkeypatch, tmp_path):
    x, y, train = labelled(spark)
    few = {"components": 8, "tol": 1e-3}
    kept = M.train_one("Support Vector Machine", train, few).model
    monkeypatch.setattr(M, "PROJECTED_BYTES", 0)
    monkeypatch.setattr(P, "STEP_ROWS", 64)
    model = M.train_one("Support Vector Machine", train, few).model
    z = np.stack([r["rff"].toArray() for r in model.stages[0].transform(train).orderBy("id").collect()])
    for c in range(3):
        ours, sparks = (loss(z, y, c, m.stages[1].models[c], len(y)) for m in (model, kept))
        assert ours <= sparks * 1.01
    said = model.transform(train).select("id", "prediction", "probability").join(
        kept.transform(train).select("id", F.col("prediction").alias("p")), "id").collect()
    assert np.mean([r["prediction"] == r["p"] for r in said]) > 0.95
    assert all(abs(r["probability"].toArray().sum() - 1) < 1e-9 for r in said)
    model.write().save(f"file://{tmp_path}/svm")
    again = PipelineModel.load(f"file://{tmp_path}/svm").transform(train).select("id", F.col("prediction").alias("q"))
    assert model.transform(train).join(again, "id").where("prediction <> q").count() == 0


def test_no_projected_table_is_kept(spark, monkeypatch):
    _, _, train = labelled(spark, 100)
    kept = []
    frame = type(train)
    persist = frame.persist
    monkeypatch.setattr(frame, "persist", lambda df, *a: kept.append(df.columns) or persist(df, *a))
    monkeypatch.setattr(M, "PROJECTED_BYTES", 0)
    M.train_one("Support Vector Machine", train, {"components": 4, "tol": 1e-2})
    assert not any("rff" in columns for columns in kept)


def test_margins_are_of_the_model_of_the_row_s_fold(spark):
    rows = spark.createDataFrame([(0.0, Vectors.dense([1.0, 2.0]), 0), (1.0, Vectors.dense([3.0, -1.0]), 1)], ["label", "features", "fold"])
    models = {0: (np.array([[1.0], [0.0]]), np.array([0.5])), 1: (np.array([[0.0], [2.0]]), np.array([0.0]))}
    found = {r["label"]: r["rawPrediction"].toArray().tolist() for r in P.margins(rows, P.Projection(), models).collect()}
    assert found == {0.0: [1.5], 1.0: [-2.0]}
