"""The approximate k-NN search against brute force."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablesmith.operators.models.knn import KNN
from tablesmith.operators.models.knn_lsh import BucketIndex


def frame(spark, x):
    rows = [(i, v, float(i % 3)) for i, v in enumerate(x.tolist())]
    return spark.createDataFrame(rows, "id long, x array<double>, label double").select(
        "id", array_to_vector("x").alias("features"), "label").cache()


def clusters(n=3000, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    return rng.normal(scale=8.0, size=(30, dim))[rng.integers(0, 30, n)] + rng.normal(scale=0.5, size=(n, dim))


def recall_of(got, x, train_ids, queries, k):
    hit = 0
    for q in queries:
        d = np.sqrt(((x[train_ids] - x[q]) ** 2).sum(axis=1))
        hit += len(set(got[q]) & set(train_ids[np.lexsort((train_ids, d))[:k]].tolist()))
    return hit / (k * len(queries))


def by_query(rows):
    got = {}
    for r in sorted(rows, key=lambda r: (r["qid"], r["rank"])):
        got.setdefault(r["qid"], []).append(r["tid"])
    return got


def test_recall_and_work_on_clusters(spark):
    x = clusters()
    df = frame(spark, x)
    model = KNN(k=5, idCol="id", approxRecall=0.95).fit(df.where("id % 5 != 0"))
    got = by_query(model.neighbours(df.where("id % 5 = 0"), "id").collect())
    train_ids, queries = np.array([i for i in range(len(x)) if i % 5]), list(range(0, len(x), 5))
    assert set(got) == set(queries) and all(len(v) == len(set(v)) == 5 for v in got.values())
    assert recall_of(got, x, train_ids, queries, 5) >= 0.92
    index = model._buckets
    assert index.recall >= 0.95
    share = index.candidate_share(model._queries(df.where("id % 5 = 0"), "id"))
    assert share < 1.5, share  # six tables: 6 would be every pair
    assert model.transform(df.where("id % 5 = 0")).where(F.col("prediction").isNull()).count() == 0


def test_hot_key_is_cut_into_chunks(spark):
    """A third of the rows are one vector: no task gets more than blockRows of them, nothing is lost."""
    x = clusters(900)
    x[:300] = x[0]
    df = frame(spark, x)
    train = df.select("id", "features", "label")
    model = KNN(k=5, idCol="id", blockRows=40, approxRecall=0.9).fit(train)
    got = by_query(model.neighbours(df, "id").collect())
    assert len(got) == 900 and all(len(v) == 5 for v in got.values())
    assert got[7] == got[250] == [0, 1, 2, 3, 4]  # equal distances: the smaller ids
    assert model._buckets.rows.groupBy("block").count().agg(F.max("count")).first()[0] < 90
    routed = model._buckets.routed(model._queries(df, "id"))
    assert routed.groupBy("qb", "block").count().agg(F.max("count")).first()[0] < 90


def test_few_rows_and_far_queries(spark):
    """Queries that share no key with enough rows are answered by the exact search; few rows give all of them."""
    x = np.vstack([clusters(200), np.full((3, 16), 500.0)])
    df = frame(spark, x)
    model = KNN(k=4, idCol="id", approxRecall=0.9).fit(df.where("id < 200"))
    got = by_query(model.neighbours(df.where("id >= 200"), "id").collect())
    d = np.sqrt(((x[:200] - x[200]) ** 2).sum(axis=1))
    assert got == {q: np.lexsort((np.arange(200), d))[:4].tolist() for q in (200, 201, 202)}
    tiny = KNN(k=9, idCol="id", approxRecall=0.9).fit(df.where("id < 3"))
    assert {len(v) for v in by_query(tiny.neighbours(df.where("id < 50"), "id").collect()).values()} == {3}
    one = KNN(k=2, idCol="id", approxRecall=0.9).fit(df.where("id = 1"))
    assert by_query(one.neighbours(df.where("id < 4"), "id").collect()) == {q: [1] for q in range(4)}
    none = KNN(k=2, idCol="id", approxRecall=0.9).fit(df.where("false"))
    assert none.neighbours(df, "id").collect() == [] and model.neighbours(df.where("false"), "id").collect() == []


def test_arguments(spark):
    df = frame(spark, clusters(50))
    with pytest.raises(ValueError, match="euclidean"):
        KNN(metric="manhattan", approxRecall=0.9).fit(df).neighbours(df, "id")
    with pytest.raises(ValueError, match="recall"):
        BucketIndex(df.select(F.col("id").alias("tid")), 1.5, 5)
