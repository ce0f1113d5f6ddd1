"""Kendall tau-b, exact, without pairing rows and without a task that
holds a whole column.

tau_b = (n_c - n_d) / sqrt((n0 - n1) (n0 - n2)), and
n_c - n_d = n0 - n1 - n2 + n3 - 2 n_d, where n0 = n(n-1)/2, n1 / n2 / n3 are
the pairs tied on x / y / both (sums of t(t-1)/2 over value counts: plain
aggregates) and n_d counts pairs with x_p < x_q and y_p > y_q.

n_d is a weighted inversion count. The distinct points (x, y, weight) are
numbered in (x, y) order (bounded running totals) and cut into blocks of at
most ``max_task_rows``; in that order a pair is discordant exactly when the
earlier point has the larger y, because equal x come in ascending y. Inside a
block one task counts inversions with numpy, a bit of the place at a time; between blocks a
merge-sort style decomposition runs log2(blocks) levels of running totals.
No row is paired with another and no task holds more than a block.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_double, numeric_columns
from .ranking import running_totals

DEFAULT_MAX_TASK_ROWS = 200_000
BIG = "decimal(38,0)"


def _inversions(y: np.ndarray, w: np.ndarray) -> int:
    """Sum of w_p * w_q over places p < q with y_p > y_q. The places are taken in order of y; bit by bit, from the
    highest, they are dealt into halves of halves, and in each group a place of the left half counts the
    weight of the right half's places that stand before it, which have the smaller y."""
    n = len(y)
    place = np.lexsort((np.arange(n), y))  # equal y: the earlier place first, so it counts nothing
    whole = int(w.sum(dtype=object)) ** 2 < 1 << 62
    weight = w.astype(np.int64 if whole else object)[place]
    total = 0
    for bit in range(max(0, (n - 1).bit_length()) - 1, -1, -1):
        group = place >> (bit + 1)
        right = (place >> bit) & 1
        before = np.cumsum(weight * right)
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        base = np.repeat(np.r_[before[:1] * 0, before[starts[1:] - 1]], np.diff(np.r_[starts, n]))
        total += int(((before - base) * weight * (1 - right)).sum())
        order = np.argsort(place >> bit, kind="stable")
        place, weight = place[order], weight[order]
    return total


def _weighted_inversions(pdf: pd.DataFrame) -> pd.DataFrame:
    """The inversions of a block of points, in (x, y) order."""
    pdf = pdf.sort_values(["x", "y"], kind="mergesort")
    total = _inversions(pdf["y"].to_numpy(), pdf["w"].to_numpy())
    return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "inv": [str(total)]})


def discordant_pairs(points: DataFrame, max_task_rows: int = DEFAULT_MAX_TASK_ROWS) -> int:
    """n_d of weighted points (x double, y double, w long): pairs with x_p < x_q
    and y_p > y_q, weighted by w_p * w_q.

    Points are numbered in (x, y) order and cut into blocks of at most
    ``max_task_rows``. In that order a pair is discordant exactly when the
    earlier point has the larger y (equal x come in ascending y), so n_d is an
    inversion count: inside each block one task counts it (``_inversions``);
    between blocks a merge-sort decomposition is used - at level l, within
    each group of 2^(l+1) consecutive blocks, right-half points count the
    left-half weight with a larger y through bounded running totals over
    (y desc, right half first among equal y). log2(blocks) levels."""
    t = points.withColumn("_g", F.lit(0)).withColumn("_one", F.lit(1))
    pos = running_totals(t, ["_g"], ["x", "y"], ["_one"], max_task_rows)
    blocks = pos.select("x", "y", "w", ((F.col("_one_cum") - 1) / F.lit(max_task_rows)).cast("long").alias("block"))
    from ..session import cut_lineage
    blocks = cut_lineage(blocks)  # read once per level below
    inner = (blocks.groupBy("block").applyInPandas(_weighted_inversions, "block long, inv string")
             .agg(F.sum(F.col("inv").cast(BIG)).alias("s"), F.count(F.lit(1)).alias("b")).first())
    total, n_blocks = int(inner["s"] or 0), int(inner["b"] or 0)
    level = 0
    while (1 << level) < n_blocks:
        side = F.shiftright(F.col("block"), level).bitwiseAND(F.lit(1))
        t = blocks.select(F.shiftright(F.col("block"), level + 1).alias("grp"), side.alias("side"), "y", "w",
                          F.when(side == 0, F.col("w")).otherwise(F.lit(0)).alias("wl"))
        cum = running_totals(t, ["grp"], [F.col("y").desc(), F.col("side").desc()], ["wl"], max_task_rows)
        cross = cum.where(F.col("side") == 1).agg(F.sum(F.col("w").cast(BIG) * F.col("wl_cum").cast(BIG))).first()[0]
        total += int(cross or 0)
        level += 1
    return total


def kendall_tau_b(df: DataFrame, a: str, b: str, max_task_rows: int = DEFAULT_MAX_TASK_ROWS) -> float | None:
    """tau-b of two numeric columns over the rows where both are present."""
    x, y = as_double(df, a), as_double(df, b)
    pts = (df.select(x.alias("x"), y.alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())
           .groupBy("x", "y").agg(F.count(F.lit(1)).alias("w")))
    big = lambda c: F.col(c).cast(BIG)
    ties = lambda g: pts.groupBy(g).agg(F.sum("w").alias("t")).agg(
        F.sum(big("t") * (big("t") - 1) / 2).alias("p"))
    n = pts.agg(F.sum(big("w")).alias("n"), F.sum(big("w") * (big("w") - 1) / 2).alias("n3")).first()
    if not n["n"] or n["n"] < 2:
        return None
    N = int(n["n"])
    n0 = N * (N - 1) // 2
    n1 = int(ties("x").first()["p"] or 0)
    n2 = int(ties("y").first()["p"] or 0)
    n3 = int(n["n3"] or 0)
    if n0 == n1 or n0 == n2:
        return None
    nd = discordant_pairs(pts, max_task_rows)
    return (n0 - n1 - n2 + n3 - 2 * nd) / math.sqrt((n0 - n1) * (n0 - n2))


def kendall(df: DataFrame, columns: list[str] | None = None,
            max_task_rows: int = DEFAULT_MAX_TASK_ROWS) -> DataFrame:
    """Long matrix like P10 with Kendall tau-b (3 dp), pairwise-complete."""
    from .correlation import SCHEMA, _matrix
    cols = columns if columns is not None else numeric_columns(df)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], SCHEMA)
    spread = df.agg(*[(F.countDistinct(as_double(df, c)) >= 2).alias(f"d{i}") for i, c in enumerate(cols)]).first()
    r = {}
    for i in range(len(cols)):
        r[(i, i)] = 1.0 if spread[f"d{i}"] else None
        for j in range(i + 1, len(cols)):
            r[(i, j)] = kendall_tau_b(df, cols[i], cols[j], max_task_rows)
    return _matrix(df.sparkSession, cols, r)
