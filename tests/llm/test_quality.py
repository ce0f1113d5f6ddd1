"""op3, op5, op7: counts against plain Python, EM and the linear models on cases with a known answer."""

import brute
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tablesmith.llm import classifier, linear, rules, toxicity, weak
from tablesmith.llm.queries import QUERIES


def test_counts(spark, table_dir, edge_rows):
    rows = QUERIES["op3_quality_rules"](spark, table_dir).collect()
    got = sorted((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows)
    assert got == sorted(brute.quality_counts(r[1]) for r in edge_rows)
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_counts_on_documents(docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rules.counts(docs).collect():
        assert brute.quality_counts(texts[r["doc_id"]]) == (
            r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])


def em(votes, rounds=weak.ROUNDS):
    """The same EM over rows in numpy."""
    v = np.array(votes)
    k = v.shape[1]
    start = weak.first_guess(k)
    prior, good, bad = start.prior, np.array(start.good), np.array(start.bad)
    for _ in range(rounds):
        odds = np.log(prior / (1 - prior)) + sum(np.log(good[r][v[:, r] + 1] / bad[r][v[:, r] + 1]) for r in range(k))
        q = 1 / (1 + np.exp(-odds))
        old = prior
        good = np.array([[(q * (v[:, r] == x)).sum() + weak.SMOOTH for x in (-1, 0, 1)] for r in range(k)])
        bad = np.array([[((1 - q) * (v[:, r] == x)).sum() + weak.SMOOTH for x in (-1, 0, 1)] for r in range(k)])
        prior = good[0].sum() / (good[0].sum() + bad[0].sum())
        good[:, 0] = np.minimum(good[:, 0], weak.MAX_FALSE / (1 - weak.MAX_FALSE) * (good[:, 1] + good[:, 2]))
        good, bad = good / good.sum(1, keepdims=True), bad / bad.sum(1, keepdims=True)
        if abs(prior - old) < weak.TOLERANCE:
            break
    return prior, good, bad


def test_em_equals_numpy(spark):
    rng = np.random.default_rng(3)
    truth = rng.random(400) < 0.8
    votes = [[int(np.where(t, rng.choice([0, 1, 1, 1]), rng.choice([-1, -1, 0, 1]))) for _ in range(4)] for t in truth]
    model = weak.fit(spark.createDataFrame([(v,) for v in votes], "votes array<int>"), 4)
    prior, good, bad = em(votes)
    assert np.isclose(model.prior, prior) and np.allclose(model.good, good) and np.allclose(model.bad, bad)
    df = spark.createDataFrame([(v,) for v in votes], "votes array<int>").select(model.posterior(F.col("votes")).alias("p"))
    right = np.mean([(r["p"] >= 0.5) == t for r, t in zip(df.collect(), truth, strict=True)])
    assert right > 0.95 and min(model.accuracies) > 0.6


def test_rules_keep_clean_and_drop_junk(spark):
    rng = np.random.default_rng(0)
    def word():
        return "".join(rng.choice(list("abcdefghij"), rng.integers(2, 9)))
    clean = [(i, "\n".join(" ".join(word() for _ in range(9)) + "." for _ in range(12))) for i in range(40)]
    junk = [(100 + i, " ".join(word() + rng.choice(["$$$", "###"]) for _ in range(120))) for i in range(6)]
    out = {r["doc_id"]: r["kept"] for r in rules.judge(spark.createDataFrame(clean + junk, "doc_id long, text string")).collect()}
    assert all(out[i] for i, _ in clean) and not any(out[i] for i, _ in junk)


def test_logistic_regression_optimum():
    rng = np.random.default_rng(0)
    index = pd.Series([rng.choice(50, 5, replace=False) for _ in range(300)])
    y = np.array([1.0 if 7 in x or 9 in x else 0.0 for x in index])
    rows = linear.Rows(index, 50)
    w = linear.fit(rows, y, np.ones(300), 0.01, rounds=200)
    grad = rows.back(linear.sigmoid(rows.margins(w)) - y) / 300
    grad[:-1] += 0.01 * w[:-1]
    assert np.abs(grad).max() < 1e-3
    assert ((rows.margins(w) > 0) == (y > 0)).mean() > 0.9


def test_classifier(spark, docs, edge, empty):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    out = classifier.classify(docs).join(labels, "doc_id").select("keep", "quality").toPandas()
    good = out[out.quality == 1]
    assert good.keep.mean() > 0.95 and (out[out.quality == 0].keep).mean() < 0.4
    rows = classifier.classify(edge).collect()
    assert len(rows) == edge.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert classifier.classify(empty).collect() == []


def test_variety_covers_the_whole_text(spark):
    fresh = [f"word{i}" for i in range(200)]
    texts = [fresh + ["again"] * 1800, ["again"] * 200 + [f"word{i}" for i in range(1800)], fresh * 10, fresh[:150], [],
             fresh + ["again"] * 50]
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["s_kinds"] for r in classifier.surface(rows, ["doc_id"]).collect()}
    for i, w in enumerate(texts):
        want = sum(len(set(w[at:at + 200])) for at in range(0, len(w), 200)) / max(1, len(w))
        assert abs(got[i] - want) < 1e-12
    votes = classifier.surface(rows, ["doc_id"]).select("doc_id", classifier.labellers()[-1].alias("v")).collect()
    assert {r["doc_id"]: r["v"] for r in votes if r["doc_id"] < 3} == {0: -1, 1: 1, 2: 1}


SF = "/root/testdata/sf0.01"  # 399 labels


def test_toxicity(spark, edge, empty):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    models = toxicity.train(toxicity.training_rows(docs, labels))
    out = toxicity.score(docs, models).join(labels, "doc_id").select(
        labels["toxic"].alias("y"), "p_insult", "p_contempt", "p_toxic").toPandas()
    assert ((out.p_toxic >= 0.5) == (out.y == 1)).mean() > 0.9
    fresh = spark.createDataFrame([(1, "you stupid worthless idiot, pathetic scum"), (2, "the weather is fine today")],
                                  "doc_id long, text string")
    got = {r["doc_id"]: r["toxic"] for r in toxicity.score(fresh, models).collect()}
    assert got == {1: True, 2: False}
    assert len(toxicity.score(edge, models).collect()) == edge.count()
    assert toxicity.score(empty, models).collect() == []
    none = toxicity.train(toxicity.training_rows(docs, labels.where("false")))
    assert {r["p_toxic"] for r in toxicity.score(edge, none).collect()} == {0.0}


def test_chain_uses_out_of_fold_probabilities(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    models = toxicity.train(toxicity.training_rows(docs, labels))
    assert [len(m) for m in models] == [toxicity.FEATURES + 1, toxicity.FEATURES + 2, toxicity.FEATURES + 3]
    assert models[-1][toxicity.FEATURES] > 0  # the label's model leans on the category before it
