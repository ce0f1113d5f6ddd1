"""Exact order statistics and quantiles that never hold a whole column in one task.

``percentile()`` keeps every distinct value of a column in one aggregation
buffer and merges it in a single task; ``approxQuantile(…, 0)`` pulls the same
into the driver. Both break on a 100 TB column. Here an exact k-th value is
found by narrowing an interval:

1. one histogram pass per round: rows inside the current interval of each
   target are bucketed into ``buckets`` equal-width buckets and counted
   (``groupBy(group, bucket).agg(count, min, max)``, partial aggregation on the
   map side, so a hot value costs nothing extra);
2. the driver reads that bounded histogram (targets x buckets rows) and keeps
   the one bucket holding rank k;
3. once an interval holds at most ``max_task_rows`` rows (or a single value),
   its values are collected and sorted inside one task (``groupBy(interval)``
   + ``sort_array(collect_list)``): a bounded sort per task.

Columns of at most ``max_task_rows`` values skip straight to step 3.
Quantiles use linear interpolation between the two order statistics around
``(n - 1) * q`` (the pandas / DuckDB ``quantile_cont`` rule).
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import as_double

DEFAULT_MAX_TASK_ROWS = 50_000
DEFAULT_BUCKETS = 1024


def long_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, v) rows for the given numeric columns, missing values dropped."""
    if not columns:
        raise ValueError("no columns")
    wide = df.select([as_double(df, c).alias(f"_c{i}") for i, c in enumerate(columns)])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_c{i}").alias("v"))
                      for i, c in enumerate(columns)])
    return (wide.select(F.inline(pairs))
            .where(F.col("v").isNotNull()))


def column_extent(df: DataFrame, columns: list[str]) -> dict[str, tuple[int, float | None, float | None]]:
    """One pass: non-missing count, min and max per column."""
    aggs = []
    for i, c in enumerate(columns):
        v = as_double(df, c)
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(columns)}


def _finite(x: float | None) -> bool:
    return x is not None and math.isfinite(x)


def order_statistics(df: DataFrame, wanted: dict[str, list[int]],
                     extent: dict[str, tuple[int, float | None, float | None]] | None = None,
                     max_task_rows: int = DEFAULT_MAX_TASK_ROWS,
                     buckets: int = DEFAULT_BUCKETS) -> dict[tuple[str, int], float]:
    """Exact 0-based order statistics ``{(column, k): value}`` of numeric columns."""
    columns = [c for c in wanted if wanted[c]]
    if not columns:
        return {}
    if extent is None:
        extent = column_extent(df, columns)
    spark = df.sparkSession
    values = long_values(df, columns)

    # one state per target (column, k); interval is (lo, hi], lo/hi None = unbounded
    state = {}
    for c in columns:
        n, vmin, vmax = extent[c]
        for k in sorted(set(wanted[c])):
            if n and 0 <= k < n:
                state[(c, k)] = dict(lo=None, hi=None, below=0, cnt=n, vmin=vmin, vmax=vmax)
    result: dict[tuple[str, int], float] = {}

    def settle():
        for key, s in list(state.items()):
            if s["vmin"] == s["vmax"]:
                result[key] = s["vmin"]
                del state[key]

    def groups_of(keys):
        g = defaultdict(list)
        for key in keys:
            s = state[key]
            g[(key[0], s["lo"], s["hi"])].append(key)
        return list(g.items())

    schema = T.StructType([
        T.StructField("gid", T.IntegerType()), T.StructField("g_feature", T.StringType()),
        T.StructField("g_lo", T.DoubleType()), T.StructField("g_hi", T.DoubleType()),
        T.StructField("g_min", T.DoubleType()), T.StructField("g_max", T.DoubleType())])

    def in_groups(groups):
        rows = []
        for gid, ((c, lo, hi), keys) in enumerate(groups):
            s = state[keys[0]]
            rows.append((gid, c, lo, hi, s["vmin"], s["vmax"]))
        g = spark.createDataFrame(rows, schema)
        cond = ((values.feature == g.g_feature)
                & (g.g_lo.isNull() | (values.v > g.g_lo))
                & (g.g_hi.isNull() | (values.v <= g.g_hi)))
        # bounded: one row per interval group (columns x requested ranks)
        return values.join(F.broadcast(g), cond, "inner")

    # infinite values have no place in a histogram: count them, settle their ranks, narrow over the rest
    odd = sorted({c for (c, _), s in state.items() if not (_finite(s["vmin"]) and _finite(s["vmax"]))})
    if odd:
        aggs = []
        for i, c in enumerate(odd):
            v = as_double(df, c)
            inside = F.when(F.abs(v) < float("inf"), v)
            aggs += [F.count(F.when(v == float("-inf"), 1)).alias(f"neg{i}"), F.count(inside).alias(f"n{i}"),
                     F.min(inside).alias(f"lo{i}"), F.max(inside).alias(f"hi{i}")]
        row = df.agg(*aggs).first()
        for i, c in enumerate(odd):
            neg, n = row[f"neg{i}"], row[f"n{i}"]
            for key in [k for k in state if k[0] == c]:
                if neg <= key[1] < neg + n:
                    state[key].update(lo=float("-inf"), hi=row[f"hi{i}"], below=neg, cnt=n, vmin=row[f"lo{i}"],
                                      vmax=row[f"hi{i}"])
                else:
                    result[key] = float("-inf") if key[1] < neg else float("inf")
                    del state[key]

    settle()
    while True:
        big = [k for k, s in state.items() if s["cnt"] > max_task_rows]
        if not big:
            break
        groups = groups_of(big)
        j = in_groups(groups)
        half = (F.col("v") / 2 - F.col("g_min") / 2) / (F.col("g_max") / 2 - F.col("g_min") / 2)
        b = F.least(F.floor(half * buckets).cast("int"), F.lit(buckets - 1))
        hist = (j.groupBy("gid", b.alias("b"))
                .agg(F.count(F.lit(1)).alias("cnt"), F.min("v").alias("mn"), F.max("v").alias("mx"))
                .collect())
        per_gid = defaultdict(list)
        for r in hist:
            per_gid[r["gid"]].append((r["b"], r["cnt"], r["mn"], r["mx"]))
        for gid, (_, keys) in enumerate(groups):
            bins = sorted(per_gid[gid])
            for key in keys:
                s = state[key]
                k_in = key[1] - s["below"]
                cum, prev_max = 0, s["lo"]
                for _, cnt, mn, mx in bins:
                    if k_in < cum + cnt:
                        s.update(lo=prev_max, hi=mx, below=s["below"] + cum, cnt=cnt, vmin=mn, vmax=mx)
                        break
                    cum += cnt
                    prev_max = mx
        settle()

    if state:
        # every remaining interval holds at most max_task_rows values: sort each
        # one inside a single task and read the wanted positions
        groups = groups_of(list(state))
        whole = all(lo is None and hi is None for (_, lo, hi), _ in groups)
        if whole:  # first round: an interval is a whole column, no join needed
            gid_of = {c: gid for gid, ((c, _, _), _) in enumerate(groups)}
            gid_col = None
            for c, gid in gid_of.items():
                gid_col = (F.when(F.col("feature") == c, gid) if gid_col is None
                           else gid_col.when(F.col("feature") == c, gid))
            j = values.where(F.col("feature").isin(list(gid_of))).withColumn("gid", gid_col)
        else:
            j = in_groups(groups)
        ranked = j.groupBy("gid").agg(F.sort_array(F.collect_list("v")).alias("sorted"))
        offsets = []
        for gid, (_, keys) in enumerate(groups):
            offsets.append((gid, [key[1] - state[key]["below"] for key in keys], [key[1] for key in keys],
                            keys[0][0]))
        off = spark.createDataFrame(offsets, "o_gid int, o_pos array<int>, o_k array<int>, o_feature string")
        picked = (ranked.join(F.broadcast(off), ranked.gid == off.o_gid)
                  .select("o_feature", "o_k", F.transform("o_pos", lambda o: F.element_at("sorted", o + 1))
                          .alias("vals"))
                  .collect())
        for r in picked:
            for k, v in zip(r["o_k"], r["vals"]):
                result[(r["o_feature"], k)] = v
    return result


def approx_quantiles(df: DataFrame, columns: list[str], probs: list[float],
                     accuracy: int = 10_000) -> dict[str, list[float | None]]:
    """Opt-in fast path: ``percentile_approx`` (bounded sketches, one pass) for
    very wide or very high-cardinality tables where exact values are not needed."""
    row = df.agg(*[F.percentile_approx(as_double(df, c), list(probs), accuracy).alias(f"q{i}")
                   for i, c in enumerate(columns)]).first()
    return {c: (list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs))
            for i, c in enumerate(columns)}


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float],
                    max_task_rows: int = DEFAULT_MAX_TASK_ROWS,
                    buckets: int = DEFAULT_BUCKETS,
                    extent=None, accuracy: int | None = None) -> dict[str, list[float | None]]:
    """``{column: [quantile per prob]}``; None for a column with no values.
    ``accuracy`` switches to the approximate sketch (see ``approx_quantiles``)."""
    if not columns:
        return {}
    if accuracy:
        return approx_quantiles(df, columns, probs, accuracy)
    if extent is None:
        extent = column_extent(df, columns)
    wanted = {}
    for c in columns:
        n = extent[c][0]
        ks = set()
        for q in probs:
            if n:
                h = (n - 1) * q
                ks.update({math.floor(h), math.ceil(h)})
        wanted[c] = sorted(ks)
    stats = order_statistics(df, wanted, extent, max_task_rows, buckets)
    out = {}
    for c in columns:
        n = extent[c][0]
        vals = []
        for q in probs:
            if not n:
                vals.append(None)
                continue
            h = (n - 1) * q
            lo, hi = math.floor(h), math.ceil(h)
            a, b = stats[(c, lo)], stats[(c, hi)]
            vals.append(a if lo == hi else a + (b - a) * (h - lo))
        out[c] = vals
    return out


def exact_median(df: DataFrame, columns: list[str], **kw) -> dict[str, float | None]:
    return {c: v[0] for c, v in exact_quantiles(df, columns, [0.5], **kw).items()}
