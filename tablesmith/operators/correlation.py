"""Correlation matrix in long form (P10 Pearson, P11 Spearman) and
high-correlation pairs (P13).

Pearson is one aggregate pass of plain sums of centred values (column sums,
squares and cross products; for a pair with missing values the sums run over
the rows where both are present - pairwise-complete, as pandas). Spearman replaces
each value by its average rank (ties share the mean of their positions), computed
from the value counts of a column with bounded running totals, then applies Pearson to the
ranks; the pairs in which a column has missing values are ranked over their own complete
rows, all pairs in one pass.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_double, is_missing, numeric_columns
from ..session import cut_lineage
from .ranking import DEFAULT_MAX_TASK_ROWS, running_totals

BROADCAST_VALUES = 2_000_000   # rows of all rank tables that are broadcast, about 150 MB in an executor
SCHEMA = "feature_1 string, feature_2 string, idx_1 int, idx_2 int, r double"


def _pearson_pairs(df: DataFrame, cols: list[str], pairs: list[tuple[int, int]],
                   means: list | None = None, gaps: list | None = None) -> dict:
    """r for each (a, b) from one pass of plain sums over values centred by the
    column means (sums stay in whole-stage codegen and the centring keeps them
    stable). Pairs of gap-free columns share the column sums; a pair with
    missing values uses sums over its complete rows only (pairwise-complete)."""
    if not pairs:
        return {}
    if means is None or gaps is None:
        pre = df.agg(*[F.avg(as_double(df, c)).alias(f"m{i}") for i, c in enumerate(cols)],
                     *[F.max(is_missing(df, c).cast("int")).alias(f"g{i}") for i, c in enumerate(cols)]).first()
        means = [pre[f"m{i}"] for i in range(len(cols))]
        gaps = [bool(pre[f"g{i}"]) for i in range(len(cols))]
    x = [as_double(df, c) - F.lit(means[i] or 0.0) for i, c in enumerate(cols)]
    used = sorted({i for p in pairs for i in p})
    aggs = [F.count(F.lit(1)).alias("n")]
    for i in used:
        if not gaps[i]:
            aggs += [F.sum(x[i]).alias(f"s{i}"), F.sum(x[i] * x[i]).alias(f"q{i}")]
    for a, b in pairs:
        if a == b and gaps[a]:
            aggs += [F.count(x[a]).alias(f"n{a}_{b}"), F.sum(x[a]).alias(f"sa{a}_{b}"),
                     F.sum(x[a] * x[a]).alias(f"qa{a}_{b}")]
        elif a != b and not gaps[a] and not gaps[b]:
            aggs.append(F.sum(x[a] * x[b]).alias(f"p{a}_{b}"))
        elif a != b:
            both = x[a].isNotNull() & x[b].isNotNull()
            xa, xb = F.when(both, x[a]), F.when(both, x[b])
            aggs += [F.count(F.when(both, 1)).alias(f"n{a}_{b}"), F.sum(xa).alias(f"sa{a}_{b}"),
                     F.sum(xb).alias(f"sb{a}_{b}"), F.sum(xa * xa).alias(f"qa{a}_{b}"),
                     F.sum(xb * xb).alias(f"qb{a}_{b}"), F.sum(xa * xb).alias(f"p{a}_{b}")]
    row = df.agg(*aggs).first()

    def corr(n, sa, sb, qa, qb, pab):
        if not n or n < 2 or sa is None or sb is None:
            return None
        va, vb = qa - sa * sa / n, qb - sb * sb / n
        if va <= 0 or vb <= 0:
            return None
        return (pab - sa * sb / n) / math.sqrt(va * vb)

    out = {}
    for a, b in pairs:
        if a == b:
            if gaps[a]:
                out[(a, b)] = 1.0 if corr(row[f"n{a}_{b}"], row[f"sa{a}_{b}"], row[f"sa{a}_{b}"],
                                          row[f"qa{a}_{b}"], row[f"qa{a}_{b}"], row[f"qa{a}_{b}"]) else None
            else:
                v = corr(row["n"], row[f"s{a}"], row[f"s{a}"], row[f"q{a}"], row[f"q{a}"], row[f"q{a}"])
                out[(a, b)] = 1.0 if v is not None else None
        elif not gaps[a] and not gaps[b]:
            out[(a, b)] = corr(row["n"], row[f"s{a}"], row[f"s{b}"], row[f"q{a}"], row[f"q{b}"], row[f"p{a}_{b}"])
        else:
            out[(a, b)] = corr(row[f"n{a}_{b}"], row[f"sa{a}_{b}"], row[f"sb{a}_{b}"], row[f"qa{a}_{b}"],
                               row[f"qb{a}_{b}"], row[f"p{a}_{b}"])
    return out


def _matrix(spark, cols: list[str], r: dict, digits: int | None = 3) -> DataFrame:
    rows = []
    for i, ci in enumerate(cols):
        for j, cj in enumerate(cols):
            v = r.get((min(i, j), max(i, j)))
            rows.append((ci, cj, i, j, None if v is None else float(v)))
    out = spark.createDataFrame(rows, SCHEMA)
    return out if digits is None else out.withColumn("r", F.round("r", digits))


def _all_pairs(n: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(n) for j in range(i, n)]


def pearson(df: DataFrame, columns: list[str] | None = None, digits: int | None = 3) -> DataFrame:
    """P10: long matrix (feature_1, feature_2, idx_1, idx_2, r 3 dp; ``digits=None``
    keeps r unrounded); fewer than two numeric columns gives an empty table."""
    cols = columns if columns is not None else numeric_columns(df)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], SCHEMA)
    return _matrix(df.sparkSession, cols, _pearson_pairs(df, cols, _all_pairs(len(cols))), digits)


def average_ranks(df: DataFrame, column: str, max_task_rows: int = DEFAULT_MAX_TASK_ROWS,
                  size: int | None = None) -> DataFrame:
    """(value, rank) for the distinct non-missing values of ``column``; ties get
    the mean of the positions they occupy (1-based). ``size``: about how many values there are, if known."""
    v = as_double(df, column)
    counts = df.select(v.alias("value")).where(F.col("value").isNotNull()).groupBy("value").agg(
        F.count(F.lit(1)).alias("n"))
    cum = running_totals(counts.withColumn("_g", F.lit(0)), ["_g"], ["value"], ["n"], max_task_rows, size=size)
    return cum.select("value", (F.col("n_cum") - F.col("n") + (F.col("n") + 1) / 2.0).alias("rank"))


def _with_ranks(df: DataFrame, cols: list[str], sizes: list[int], max_task_rows: int) -> DataFrame:
    """Each value replaced by its average rank. ``sizes`` has about the number of distinct values of each column.
    The rank tables of the columns with the fewest values are broadcast, up to BROADCAST_VALUES rows in all, so
    the rows are shuffled only for the other columns, once each (a shuffle join with skew splitting)."""
    out = df.select([as_double(df, c).alias(f"_v{i}") for i, c in enumerate(cols)])
    small, held = set(), 0
    for i in sorted(range(len(cols)), key=lambda i: sizes[i]):
        held += sizes[i]
        if held <= BROADCAST_VALUES and sizes[i] <= max_task_rows:
            small.add(i)
    for i in sorted(range(len(cols)), key=lambda i: i in small):  # shuffles first, then lookups and sums in one stage
        r = average_ranks(df, cols[i], max_task_rows, sizes[i]).toDF(f"_v{i}", f"_r{i}")
        out = out.join(F.broadcast(r) if i in small else r, f"_v{i}", "left")
    return out.select([F.col(f"_r{i}").alias(c) for i, c in enumerate(cols)])


def _pairwise_spearman(df: DataFrame, cols: list[str], pairs: list[tuple[int, int]], max_task_rows: int) -> dict:
    """r of each pair over the rows in which both columns have a value, for all pairs in one go: the distinct value
    pairs are counted in one long table, both sides of all pairs are ranked in one pass (grouped by pair and
    side), and the ranks come back by two joins on (pair, value)."""
    if not pairs:
        return {}
    v = [as_double(df, c) for c in cols]
    cells = [F.struct(F.lit(i).alias("pair"), v[a].alias("a"), v[b].alias("b")) for i, (a, b) in enumerate(pairs)]
    points = cut_lineage(df.select(F.inline(F.array(*cells))).where("a IS NOT NULL AND b IS NOT NULL").groupBy(
        "pair", "a", "b").agg(F.count(F.lit(1)).alias("n")))
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("value")) for s, c in enumerate("ab")])
    counts = points.select("pair", "n", F.inline(sides)).groupBy("pair", "side", "value").agg(F.sum("n").alias("n"))
    cum = running_totals(counts, ["pair", "side"], ["value"], ["n"], max_task_rows)
    ranks = cum.select("pair", "side", "value", (F.col("n_cum") - F.col("n") + (F.col("n") + 1) / 2.0).alias("rank"))
    rows = points
    for s, c in enumerate("ab"):
        mine = ranks.where(F.col("side") == s).select("pair", F.col("value").alias(c), F.col("rank").alias("r" + c))
        rows = rows.join(mine, ["pair", c])
    # the mean of the average ranks of n rows is (n + 1) / 2
    n = {x["pair"]: x["n"] for x in points.groupBy("pair").agg(F.sum("n").alias("n")).collect()}  # one row per pair
    mean = F.array(*[F.lit((n.get(i, 0) + 1) / 2.0) for i in range(len(pairs))])[F.col("pair")]
    da, db = F.col("ra") - mean, F.col("rb") - mean
    sums = rows.groupBy("pair").agg(F.sum(F.col("n") * da * da).alias("qa"), F.sum(F.col("n") * db * db).alias("qb"),
                                    F.sum(F.col("n") * da * db).alias("p")).collect()
    out = dict.fromkeys(pairs)
    for x in sums:
        if x["qa"] > 0 and x["qb"] > 0:
            a, b = pairs[x["pair"]]
            out[a, b] = 1.0 if a == b else x["p"] / math.sqrt(x["qa"] * x["qb"])
    return out


def spearman(df: DataFrame, columns: list[str] | None = None,
             max_task_rows: int = DEFAULT_MAX_TASK_ROWS) -> DataFrame:
    """Pearson of average ranks, pairwise-complete like pandas."""
    cols = columns if columns is not None else numeric_columns(df)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], SCHEMA)
    gaps = df.agg(F.count(F.lit(1)).alias("_n"),
                  *[F.max(is_missing(df, c).cast("int")).alias(f"g{i}") for i, c in enumerate(cols)],
                  *[F.approx_count_distinct(as_double(df, c)).alias(f"d{i}") for i, c in enumerate(cols)]).first()
    has_gaps = [bool(gaps[f"g{i}"]) for i in range(len(cols))]
    full = [i for i in range(len(cols)) if not has_gaps[i]]
    r = {}
    if full:
        ranked = _with_ranks(df, [cols[i] for i in full], [gaps[f"d{i}"] for i in full], max_task_rows)
        sub = [cols[i] for i in full]
        # average ranks of n gap-free values always have mean (n + 1) / 2: one pass, no pre-aggregate
        mean_rank = (gaps["_n"] + 1) / 2.0
        pr = _pearson_pairs(ranked, sub, _all_pairs(len(sub)), means=[mean_rank] * len(sub),
                            gaps=[False] * len(sub))
        r.update({(full[a], full[b]): v for (a, b), v in pr.items()})
    r.update(_pairwise_spearman(df, cols, [p for p in _all_pairs(len(cols)) if p not in r], max_task_rows))
    return _matrix(df.sparkSession, cols, r)


def correlation(df: DataFrame, method: str = "pearson", columns: list[str] | None = None) -> DataFrame:
    if method == "pearson":
        return pearson(df, columns)
    if method == "spearman":
        return spearman(df, columns)
    if method == "kendall":
        from .kendall import kendall
        return kendall(df, columns)
    raise ValueError(f"unknown method {method!r}")


def high_correlation_pairs(matrix: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Pairs i < j with |r| >= threshold, by |r| desc (then by position)."""
    return (matrix.where((F.col("idx_1") < F.col("idx_2")) & (F.abs("r") >= F.lit(threshold)))
            .select("feature_1", "feature_2", "r", "idx_1", "idx_2")
            .orderBy(F.desc(F.abs("r")), "idx_1", "idx_2")
            .drop("idx_1", "idx_2"))
