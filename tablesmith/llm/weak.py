"""Weak supervision: expectation-maximisation over the votes of overlapping rules.

A rule votes good (1), bad (-1) or abstains (0). For the two classes each rule has
its own probabilities of the three votes (its accuracy on good and on bad rows,
and how often it abstains). The rows are first counted by their pattern of votes,
at most 3 ** rules patterns, so the rounds run over that small table whatever the
size of the input, and only the sums of a round, three numbers a rule, reach the
driver. DataFrame expressions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.common import stored

ROUNDS = 15
SMOOTH = 1.0
#: a rule calls at most this share of good rows bad; keeps a rule that alone finds one kind of bad row from being
#: explained away as noise on good rows
MAX_FALSE = 0.002
TOLERANCE = 1e-5


@dataclass(frozen=True)
class VoteModel:
    """Share of good rows; per rule the probabilities of the votes -1, 0, 1 for good and for bad rows."""
    prior: float
    good: tuple[tuple[float, float, float], ...]
    bad: tuple[tuple[float, float, float], ...]

    @property
    def accuracies(self) -> list[float]:
        """Probability that a rule, if it votes, votes right."""
        out = []
        for g, b in zip(self.good, self.bad, strict=True):
            right = self.prior * g[2] + (1 - self.prior) * b[0]
            wrong = self.prior * g[0] + (1 - self.prior) * b[2]
            out.append(right / (right + wrong))
        return out

    def posterior(self, votes: Column) -> Column:
        """Probability that a row with this array of votes is good."""
        weight = F.array(*[F.lit(math.log(x / y)) for g, b in zip(self.good, self.bad, strict=True)
                           for x, y in zip(g, b, strict=True)])
        odds = F.aggregate(F.transform(votes, lambda v, i: F.get(weight, 3 * i + v + 1)),
                           F.lit(math.log(self.prior / (1 - self.prior))), lambda acc, x: acc + x)
        return 1 / (1 + F.exp(-odds))


def first_guess(rules: int) -> VoteModel:
    """Rules are better than chance: a bad vote is rare on good rows, a good vote less rare on bad ones."""
    return VoteModel(0.8, ((0.002, 0.198, 0.8),) * rules, ((0.4, 0.2, 0.4),) * rules)


def fit(patterns: DataFrame, rules: int, rounds: int = ROUNDS) -> VoteModel:
    """EM over ``patterns`` (votes, an array; one row per input row or with a count column n).
    An empty input gives the first guess."""
    n = F.sum("n") if "n" in patterns.columns else F.count("*")
    counts = stored(patterns.groupBy("votes").agg(n.alias("n")).coalesce(1), "vote-patterns")
    model = first_guess(rules)
    for _ in range(rounds):
        rows = counts.select("n", (F.col("n") * model.posterior(F.col("votes"))).alias("q"), F.posexplode("votes"))
        sums = {(r["pos"], r["col"]): (r["q"], r["n"]) for r in rows.groupBy("pos", "col").agg(
            F.sum("q").alias("q"), F.sum("n").alias("n")).collect()}  # three rows a rule at most
        if not sums:
            return model
        good = [[sums.get((r, v), (0.0, 0))[0] + SMOOTH for v in (-1, 0, 1)] for r in range(rules)]
        bad = [[sums.get((r, v), (0.0, 0))[1] - sums.get((r, v), (0.0, 0))[0] + SMOOTH for v in (-1, 0, 1)]
               for r in range(rules)]
        prior = sum(good[0]) / (sum(good[0]) + sum(bad[0]))
        for row in good:
            row[0] = min(row[0], MAX_FALSE / (1 - MAX_FALSE) * (row[1] + row[2]))
        new = VoteModel(prior, *(tuple(tuple(x / sum(row) for x in row) for row in side) for side in (good, bad)))
        if abs(new.prior - model.prior) < TOLERANCE:
            return new
        model = new
    return model
