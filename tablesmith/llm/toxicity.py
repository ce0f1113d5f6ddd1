"""Toxicity by a classifier chain.

The categories are predicted one after the other; each model is a logistic
regression over hashed words (present or not) and over the probabilities of the
categories before it. In training these probabilities are out of fold: the rows
are dealt to folds by a hash of the id, and a row's probability comes from the
model of the other folds, so a later model sees earlier ones as wrong as they are
on new text. For scoring each category has one model over all training rows.

The last category is the label itself. The others are the label together with a
word of the category's list. The training rows are those of at most ``FIT_ROWS``
labelled ids (the smallest id hashes) with at most ``FIT_WORDS`` hashed words, so
the sample that the driver fits on is bounded; scoring covers every whole text.

Defined results: a null or empty text has no words and gets the models'
intercepts; null labels and null ids are not learnt from, several labels of an id
count as the largest, repeated rows of an id are one training row each up to
``FIT_ROWS``; without training rows all probabilities are 0; repeated rows are
scored each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.common import text_or_empty
from tablesmith.llm.linear import Rows, fit, hashed, sigmoid

FIT_ROWS = 8000
FIT_WORDS = 2000
FEATURES = 1 << 17
FOLDS = 3
STRENGTH = 0.0005
FLAG_FROM = 0.5

#: fixed seed words of the categories before the label
CATEGORIES = {
    "insult": ("idiot", "stupid", "moron", "clown", "loser", "dumb", "fool", "imbecile"),
    "contempt": ("trash", "scum", "worthless", "pathetic", "disgusting", "filth", "vermin", "garbage"),
}
CHAIN = (*CATEGORIES, "toxic")


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> pd.DataFrame:
    """words, fold and a 0/1 column per category; at most ``limit`` rows."""
    some = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(
        (F.max("toxic") > 0).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", word_list(text_or_empty()).alias("w")).join(F.broadcast(some), "doc_id")
    def has(seeds):
        return F.exists("w", lambda w: w.isin(*seeds))
    return rows.select(
        "doc_id", hashed(F.col("w"), FEATURES).alias("words"),
        F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold"),
        *[(F.col("y") & has(seeds)).cast("double").alias(c) for c, seeds in CATEGORIES.items()],
        F.col("y").cast("double").alias("toxic")).where(F.size("words") <= FIT_WORDS).orderBy(
        F.xxhash64("doc_id"), "doc_id", F.xxhash64("words")).limit(limit).toPandas()


def train(rows: pd.DataFrame) -> list[np.ndarray]:
    """The weights of the chain's models, fitted with out-of-fold probabilities; none without rows."""
    if rows.empty:
        return []
    models, out_of_fold, fold = [], np.zeros((len(rows), 0)), rows["fold"].to_numpy()
    for category in CHAIN:
        y, p = rows[category].to_numpy(), np.zeros(len(rows))

        def model(at):
            return fit(Rows(rows["words"][at], FEATURES, dense=out_of_fold[at]), y[at], np.ones(at.sum()), STRENGTH)
        models.append(model(np.ones(len(rows), bool)))
        for f in range(FOLDS if category != CHAIN[-1] else 0):
            at = fold == f
            if at.any() and not at.all():
                p[at] = sigmoid(Rows(rows["words"][at], FEATURES, dense=out_of_fold[at]).margins(model(~at)))
        out_of_fold = np.column_stack((out_of_fold, p))
    return models


def score(docs: DataFrame, models: list[np.ndarray]) -> DataFrame:
    """doc_id, the probability of each category in chain order, and toxic (the last one at FLAG_FROM or more)."""
    shared = docs.sparkSession.sparkContext.broadcast([w.astype(np.float32) for w in models])  # a vector per category

    @F.pandas_udf(", ".join(f"p_{c} double" for c in CHAIN))
    def chain(words: pd.Series) -> pd.DataFrame:
        earlier = np.zeros((len(words), 0))
        for i in range(len(CHAIN)):
            p = sigmoid(Rows(words, FEATURES, dense=earlier).margins(shared.value[i])) if shared.value else np.zeros(
                len(words))
            earlier = np.column_stack((earlier, p))
        return pd.DataFrame(earlier, columns=[f"p_{c}" for c in CHAIN])

    rows = docs.select("doc_id", chain(hashed(word_list(text_or_empty()), FEATURES)).alias("p"))
    return rows.select("doc_id", "p.*", (F.col(f"p.p_{CHAIN[-1]}") >= FLAG_FROM).alias("toxic"))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """The chain fitted on ``labels`` and applied to the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, train(training_rows(docs, labels)))
