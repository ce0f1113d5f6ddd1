import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tablesmith.operators.models import catalogue as M
from tablesmith.operators.models.knn import KNN
from tablesmith.operators.models.naive_bayes import GaussianNB


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    X = np.vstack([rng.normal(0, 1, (60, 3)), rng.normal(1.5, 1, (60, 3))]).round(3)
    y = np.array([0.0] * 60 + [1.0] * 60)
    rows = [(i, X[i].tolist(), float(y[i])) for i in range(len(y))]
    df = spark.createDataFrame(rows, "id long, x array<double>, label double")
    return X, y, df.select("id", array_to_vector("x").alias("features"), "label")


def test_naive_bayes_matches_formula(data):
    X, y, df = data
    m = GaussianNB(varSmoothing=1e-9).fit(df)
    eps = 1e-9 * X.var(axis=0).max()
    jll = []
    for c in (0.0, 1.0):
        Xc = X[y == c]
        mu, var = Xc.mean(axis=0), Xc.var(axis=0) + eps
        jll.append(np.log(len(Xc) / len(X)) - 0.5 * np.log(2 * np.pi * var).sum()
                   - 0.5 * (((X - mu) ** 2) / var).sum(axis=1))
    jll = np.array(jll).T
    prob = np.exp(jll - jll.max(axis=1, keepdims=True))
    prob /= prob.sum(axis=1, keepdims=True)
    out = m.transform(df).orderBy("id").select("prediction", vector_to_array("probability").alias("p")).collect()
    assert [r.prediction for r in out] == list(jll.argmax(axis=1).astype(float))
    assert np.allclose([r.p for r in out], prob, atol=1e-9)


@pytest.mark.parametrize("metric,weights", [("euclidean", "uniform"), ("manhattan", "distance")])
def test_knn_matches_brute_force(data, metric, weights):
    X, y, df = data
    train, test = df.where("id % 4 != 0"), df.where("id % 4 = 0")
    model = KNN(k=5, metric=metric, weights=weights, blockRows=17, idCol="id").fit(train)
    got = {r.id: r.prediction for r in model.transform(test).select("id", "prediction").collect()}
    tr_idx = [i for i in range(len(y)) if i % 4]
    for q in [i for i in range(len(y)) if i % 4 == 0]:
        diff = X[tr_idx] - X[q]
        d = np.abs(diff).sum(axis=1) if metric == "manhattan" else np.sqrt((diff ** 2).sum(axis=1))
        order = np.lexsort((np.array(tr_idx), d))[:5]
        w = np.ones(5) if weights == "uniform" else 1.0 / d[order]
        votes = {}
        for j, wt in zip(order, w):
            votes[y[tr_idx][j]] = votes.get(y[tr_idx][j], 0) + wt
        best = max(sorted(votes), key=lambda c: votes[c])
        assert got[q] == best


def test_knn_zero_distance_counts_only_exact(spark):
    train = spark.createDataFrame([(1, [0.0], 1.0), (2, [5.0], 0.0), (3, [5.1], 0.0)], "id long, x array<double>, label double")
    train = train.select("id", array_to_vector("x").alias("features"), "label")
    m = KNN(k=3, weights="distance", idCol="id").fit(train)
    q = spark.createDataFrame([([0.0],)], "x array<double>").select(array_to_vector("x").alias("features"))
    r = m.transform(q).select("prediction", vector_to_array("probability").alias("p")).first()
    assert r.prediction == 1.0 and r.p == [0.0, 1.0]


def test_catalogue_and_training(spark, data):
    _, _, df = data
    assert len(M.CATALOGUE) == 7 and M.catalogue_frame(spark).count() == 7
    with pytest.raises(ValueError):
        M.create("Nope")
    ok, errs = M.train_all(df, ["Naive Bayes", "Rule-Based", "Logistic Regression", "K-Nearest Neighbors"])
    assert set(ok) == {"Naive Bayes", "Rule-Based", "Logistic Regression", "K-Nearest Neighbors"}
    assert errs.count() == 0
    w = M.balanced_weights(df).groupBy("label").agg(F.sum("weight").alias("s")).collect()
    assert all(abs(r.s - 60.0) < 1e-9 for r in w)
    imp = M.feature_importance(ok["Rule-Based"], ["a", "b", "c"])
    assert imp.count() == 3
    assert M.decision_rules(ok["Rule-Based"], ["a", "b", "c"], 2).count() > 0


def clustered(spark, n=3000, centres=12, dim=4, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim)) * 50
    x = middle[rng.integers(0, centres, n)] + rng.normal(size=(n, dim))
    x[100:400] = x[7]   # repeated rows: equal distances, cut by the smaller id
    y = rng.integers(0, 3, n).astype(float)
    rows = [(i, v, c) for i, (v, c) in enumerate(zip(x.tolist(), y.tolist()))]
    df = spark.createDataFrame(rows, "id long, x array<double>, label double")
    return x, df.select("id", array_to_vector("x").alias("features"), "label").cache()


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_knn_skips_blocks_and_stays_exact(spark, metric):
    """Most (query block, block) pairs are never compared, and the neighbours are those of brute force."""
    x, df = clustered(spark)
    train, test = df.where("id % 5 != 0"), df.where("id % 5 = 0")
    model = KNN(k=7, metric=metric, blockRows=100, idCol="id").fit(train)
    search = model.search(test, "id")
    got = {}
    for r in search.neighbours().orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["tid"], r["rank"]))
    ids = np.array([i for i in range(len(x)) if i % 5])
    for q in range(0, len(x), 5):
        d = np.abs(x[ids] - x[q]).sum(axis=1) if metric == "manhattan" else np.sqrt(((x[ids] - x[q]) ** 2).sum(axis=1))
        assert [t for t, _ in got[q]] == ids[np.lexsort((ids, d))[:7]].tolist()
        assert [rank for _, rank in got[q]] == list(range(1, 8))
    first = search.round_one()
    found = search.first_found()
    pairs = first.unionByName(search.round_two(found)).select("qb", "block").distinct().count()
    every = search.queries.select("qb").distinct().count() * len(search.index.blocks.block)
    assert len(search.index.blocks.block) >= 24 and pairs < 0.3 * every, (pairs, every)


def test_knn_with_few_rows(spark):
    x, df = clustered(spark, n=420)
    model = KNN(k=50, blockRows=10, idCol="id").fit(df.where("id < 20"))
    got = model.neighbours(df.where("id >= 400"), "id").groupBy("qid").count().collect()
    assert len(got) == 20 and {r["count"] for r in got} == {20}  # all rows there are
    assert model.neighbours(df.where("false"), "id").collect() == []
    assert KNN(k=5, idCol="id").fit(df.where("false")).neighbours(df, "id").collect() == []


def test_svm_probabilities_hold_on_unseen_rows(spark):
    """A flexible SVM on noisy labels: its margins on its own rows would promise more than it keeps."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 2))
    y = ((x[:, 0] + rng.normal(scale=1.0, size=900)) > 0).astype(float)
    df = spark.createDataFrame([(i, v, c) for i, (v, c) in enumerate(zip(x.tolist(), y.tolist()))], "id long, x array<double>, label double")
    df = df.select("id", array_to_vector("x").alias("features"), "label").cache()
    model = M.train_one("Support Vector Machine", df.where("id % 3 = 0"), {"C": 10.0, "gamma": "auto", "max_iter": 60, "components": 50}).model
    out = model.transform(df.where("id % 3 <> 0")).select("label", "prediction", vector_to_array("probability").alias("p")).collect()
    right = np.mean([r.label == r.prediction for r in out])
    promised = np.mean([max(r.p) for r in out])
    assert right > 0.6 and abs(promised - right) < 0.1, (promised, right)
    high = [r for r in out if max(r.p) > 0.75]
    assert np.mean([r.label == np.argmax(r.p) for r in high]) > 0.65
    lone = df.where("id < 40").unionByName(df.where("id = 40").withColumn("label", F.lit(2.0)))  # one row of a class
    assert M.train_one("Support Vector Machine", lone, {"max_iter": 5, "components": 20}).model.transform(lone).count() == 41
