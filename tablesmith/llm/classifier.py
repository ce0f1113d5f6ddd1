"""Quality classifier from weak labels.

Heuristic labellers vote on counts of a text; expectation-maximisation over all
documents (``weak.fit``) estimates their accuracies, and each document gets the
posterior probability of being good. The posteriors are soft labels for a linear
scorer over hashed features: the words, as a unit vector of hashed counts, and the
text's surface counts in steps, hashed as well. The scorer sees what the labellers
look at in finer steps, and the words, which they don't see.

Votes and posteriors cover all documents; the scorer is fitted on at most
``FIT_ROWS`` documents, those below a hash threshold with at most ``FIT_WORDS``
hashed words, and scores every whole text.

Defined results: a null text counts as empty; repeated rows are scored each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.llm import weak
from tablesmith.llm.common import stored, text_or_empty, words
from tablesmith.llm.linear import Rows, fit, hashed, sigmoid

FIT_ROWS = 8000
FIT_WORDS = 2000
WORD_FEATURES = 1 << 15
SURFACE_FEATURES = 1 << 8
STRENGTH = 0.001
KEEP_FROM = 0.5
#: variety is the share of distinct words in consecutive windows of so many words
WINDOW = 200
#: steps of a surface count: the number of these limits it reaches
STEPS = (0.005, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 1.0, 1.5, 2.0, 3.0, 4.0,
         5.0, 6.0, 7.0, 8.0, 10.0, 12.0, 15.0, 20.0, 50.0, 100.0, 200.0, 500.0)


def _kinds(w: Column) -> Column:
    """Distinct words of each window of WINDOW words, summed over the windows: over the number of words, it is the
    mean distinct share of the windows by their length, which a longer text does not lower."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(w) - 1) / WINDOW).cast("int")))
    return F.aggregate(starts, F.lit(0), lambda acc, i: acc + F.size(F.array_distinct(F.slice(w, i * WINDOW + 1, WINDOW))))


def surface(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, place (hash of the row), _w (words) and the surface counts that the labellers look at."""
    t = F.col("_t")
    def without(pattern):
        return F.char_length(t) - F.char_length(F.regexp_replace(t, pattern, ""))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.xxhash64("doc_id", "text").alias("place"),
                       text_or_empty().alias("_t")).withColumns({
        "_w": words(t), "letters": without(r"\p{L}+"), "capitals": without(r"\p{Lu}+"),
        "digits": without(r"[0-9]+"), "marks": without(r"[#*$%&|<>{}\[\]~^_=\\]+"), "ends": without(r"[.!?]+")})
    rows = rows.withColumns({"n": F.size("_w").cast("double"), "kinds": _kinds(F.col("_w")).cast("double")})
    chars = F.greatest(F.lit(1), F.col("letters") + F.col("digits") + F.col("marks"))
    n = F.greatest(F.lit(1.0), F.col("n"))
    return rows.select(
        *[F.col(f"`{c}`") for c in keep], "place", "_w", F.col("n").alias("s_words"),
        (F.col("letters") / n).alias("s_letters"), (F.col("capitals") / F.greatest(F.lit(1), F.col("letters"))).alias(
            "s_capitals"), (F.col("digits") / chars).alias("s_digits"), (F.col("marks") / n).alias("s_marks"),
        (F.col("ends") / n).alias("s_ends"), (F.col("kinds") / n).alias("s_kinds"))


SURFACE = ("s_words", "s_letters", "s_capitals", "s_digits", "s_marks", "s_ends", "s_kinds")


def labellers() -> list[Column]:
    """The labellers' votes: size, word length, capitals, digits, marks, sentence ends, variety."""
    def vote(name, good, bad):
        return F.when(bad(F.col(name)), -1).when(good(F.col(name)), 1).otherwise(0)
    return [
        vote("s_words", lambda x: x >= 30, lambda x: x < 1),
        vote("s_letters", lambda x: x.between(3, 10), lambda x: (x < 2) | (x > 15)),
        vote("s_capitals", lambda x: x <= 0.2, lambda x: x > 0.5),
        vote("s_digits", lambda x: x <= 0.1, lambda x: x > 0.3),
        vote("s_marks", lambda x: x <= 0.1, lambda x: x > 0.4),
        vote("s_ends", lambda x: x.between(0.01, 0.5), lambda x: x > 1.0),
        vote("s_kinds", lambda x: x >= 0.4, lambda x: x < 0.25),
    ]


def with_features(rows: DataFrame) -> DataFrame:
    """Adds words and steps, the hashed indices of the words and of the surface counts in steps."""
    def step(c):
        reached = sum(((F.col(c) >= s).cast("int") for s in STEPS), F.lit(0))
        return F.concat(F.lit(c + ":"), reached.cast("string"))
    return rows.withColumn("words", hashed(F.transform("_w", lambda w: F.lower(w)), WORD_FEATURES)).withColumn(
        "steps", hashed(F.array(*[step(c) for c in SURFACE]), SURFACE_FEATURES, "surface")).drop("_w")


def _rows(words: pd.Series, steps: pd.Series) -> Rows:
    """Words as a unit vector, steps as 0/1."""
    scale = 1 / np.sqrt(np.maximum(1, np.array([len(w) for w in words])))
    dense = np.zeros((len(words), SURFACE_FEATURES))
    for i, s in enumerate(steps):
        dense[i, s] = 1
    return Rows(words, WORD_FEATURES, scale, dense)


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, posterior (of the labellers), score (of the scorer) and keep."""
    votes = labellers()
    coded = surface(docs, ["doc_id"]).withColumn("votes", F.array(*votes))
    codes = stored(coded.groupBy("votes").agg(F.count("*").alias("n")), "classifier-votes")
    model = weak.fit(codes, len(votes))
    rows = with_features(coded).withColumn("posterior", model.posterior(F.col("votes")))

    total = codes.agg(F.sum("n")).first()[0] or 0
    part = F.pmod(F.xxhash64("place"), F.lit(1_000_000)) < max(1, FIT_ROWS * 1_000_000 // max(1, total))
    sample = rows.where(part & (F.size("words") <= FIT_WORDS)).select(
        "place", "words", "steps", "posterior").orderBy(F.xxhash64("place")).limit(FIT_ROWS).toPandas()
    weights = np.zeros(WORD_FEATURES + SURFACE_FEATURES + 1)
    if len(sample):
        weights = fit(_rows(sample["words"], sample["steps"]), sample["posterior"].to_numpy(), np.ones(len(sample)),
                      STRENGTH)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # one vector

    @F.pandas_udf("double")
    def scorer(words: pd.Series, steps: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(words), 1024):
            out.append(sigmoid(_rows(words[at:at + 1024], steps[at:at + 1024]).margins(shared.value)))
        return pd.Series(np.concatenate(out) if out else [])

    out = rows.select("doc_id", "posterior", scorer("words", "steps").alias("score"))
    return out.withColumn("keep", F.col("score") >= KEEP_FROM)


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """``classify`` on the whole of ``documents``."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
