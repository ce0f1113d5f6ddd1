"""The full profile in a fixed number of passes over the table.

Pass 1  one aggregate: row count, missing count per column, count / mean /
        std / min / max / skewness / kurtosis per numeric column.
Pass 2  exact quartiles of all numeric columns at once (bounded selector).
Pass 3  one aggregate: IQR low / high counts and z-score counts per column,
        with the bounds and moments from passes 1-2 as literals.
Pass 4  the value-count table (one shuffle): top value per text column.
Pass 5  one aggregate of centred sums: Pearson for every numeric pair.

Results are small (columns, or column pairs) and are returned as cached
DataFrames with the same columns as the single operators.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (col, as_double, categorical_columns, field_type, is_missing, numeric_columns,
                                 type_name)
from ..operators import frequencies as fq
from ..operators.correlation import _pearson_pairs
from ..operators.profile import iqr_bounds
from ..operators.quantiles import exact_quantiles


@dataclass
class Profile:
    rows: int
    numeric: list
    categorical: list
    missing: DataFrame
    global_missing_pct: float
    outliers_iqr: DataFrame
    outliers_zscore: DataFrame
    correlation: DataFrame          # r rounded to 3 dp (display)
    correlation_exact: DataFrame    # r unrounded (thresholds)
    numeric_distribution: DataFrame
    categorical_distribution: DataFrame

    def unpersist(self) -> None:
        for d in (self.missing, self.outliers_iqr, self.outliers_zscore, self.correlation, self.correlation_exact,
                  self.numeric_distribution, self.categorical_distribution):
            d.unpersist()


def _r(x, d):
    """NaN -> None; the rounding itself is done by Spark (half-up, like the operators)."""
    return None if x is None or (isinstance(x, float) and math.isnan(x)) else float(x)


def _round(df: DataFrame, digits: dict) -> DataFrame:
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else col(c) for c in df.columns])


def full_profile(df: DataFrame, z_threshold: float = 3.0, **qkw) -> Profile:
    spark = df.sparkSession
    cols, nums, cats = df.columns, numeric_columns(df), categorical_columns(df)
    # ---- pass 1
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.sum(is_missing(df, c).cast("long")).alias(f"m{i}") for i, c in enumerate(cols)]
    for i, c in enumerate(nums):
        v = as_double(df, c)
        aggs += [F.count(v).alias(f"c{i}"), F.avg(v).alias(f"a{i}"), F.stddev_samp(v).alias(f"s{i}"),
                 F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.skewness(v).alias(f"g1{i}"),
                 F.kurtosis(v).alias(f"g2{i}")]
    r = df.agg(*aggs).first()
    n = r["_n"]
    # ---- pass 2
    extent = {c: (r[f"c{i}"], r[f"lo{i}"], r[f"hi{i}"]) for i, c in enumerate(nums)}
    present = [c for c in nums if extent[c][0]]
    q = exact_quantiles(df, present, [0.25, 0.5, 0.75], extent=extent, **qkw) if present else {}
    bounds = iqr_bounds({c: [v[0], v[2]] for c, v in q.items()})
    # ---- pass 3
    aggs3 = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(nums):
        v = as_double(df, c)
        if c in bounds:
            aggs3 += [F.count(F.when(v < F.lit(bounds[c][2]), 1)).alias(f"ol{i}"),
                      F.count(F.when(v > F.lit(bounds[c][3]), 1)).alias(f"oh{i}")]
        s = r[f"s{i}"]
        if s and not math.isnan(s):
            aggs3.append(F.count(F.when(F.abs((v - F.lit(r[f"a{i}"])) / F.lit(s)) > z_threshold, 1)).alias(f"z{i}"))
    r3 = df.agg(*aggs3).first()
    # ---- pass 4
    cat_top = None
    if cats:
        cat_top = fq.top_k(df, fq.value_counts(df, cats), 1, cats).select("feature", F.col("value").alias("top_value"),
                                         F.col("cnt").cast("long").alias("top_count"),
                                         F.round(F.col("cnt") * 100.0 / F.lit(n), 2).alias("top_pct"))
    # ---- assemble (all bounded by columns or column pairs)
    miss = spark.createDataFrame(
        [(c, int(r[f"m{i}"] or 0), (r[f"m{i}"] or 0) * 100.0 / n if n else 0.0,
          type_name(field_type(df, c))) for i, c in enumerate(cols)],
        "feature string, missing_count long, missing_pct double, dtype string")
    miss = _round(miss, {"missing_pct": 2})
    cells = n * len(cols)
    gm = (spark.createDataFrame([(sum((r[f"m{i}"] or 0) for i in range(len(cols))) * 100.0 / cells,)], "g double")
          .select(F.round("g", 2)).first()[0]) if cells else 0.0
    iqr_rows, z_rows, dist_rows = [], [], []
    for i, c in enumerate(nums):
        cnt = r[f"c{i}"]
        if not cnt:
            continue
        q1, q3, lo, hi = bounds[c]
        ol, oh = r3[f"ol{i}"], r3[f"oh{i}"]
        iqr_rows.append((c, _r(q1, 2), _r(q3, 2), _r(q3 - q1, 2), _r(lo, 2), _r(hi, 2), ol, oh, ol + oh,
                         _r((ol + oh) * 100.0 / cnt, 2)))
        s = r[f"s{i}"]
        zc = r3[f"z{i}"] if (s and not math.isnan(s)) else 0
        z_rows.append((c, _r(r[f"a{i}"], 2), _r(0.0 if s == 0 else s, 2), float(z_threshold), zc,
                       _r(zc * 100.0 / cnt, 2)))
        g1, g2 = r[f"g1{i}"], r[f"g2{i}"]
        sk = g1 * math.sqrt(cnt * (cnt - 1)) / (cnt - 2) if cnt > 2 and g1 is not None and not math.isnan(g1) else 0.0
        ku = (((cnt + 1) * g2 + 6) * (cnt - 1) / ((cnt - 2) * (cnt - 3))
              if cnt > 3 and g2 is not None and not math.isnan(g2) else 0.0)
        dist_rows.append((c, n, n - cnt, _r(r[f"lo{i}"], 4), _r(r[f"hi{i}"], 4), _r(r[f"a{i}"], 4),
                          _r(q[c][1], 4), _r(s, 4), _r(sk, 4), _r(ku, 4)))
    iqr = _round(spark.createDataFrame(iqr_rows, "feature string, q1 double, q3 double, iqr double, "
                                                 "lower_bound double, upper_bound double, outliers_low long, "
                                                 "outliers_high long, total_outliers long, outlier_pct double"),
                 {c: 2 for c in ("q1", "q3", "iqr", "lower_bound", "upper_bound", "outlier_pct")})
    z = _round(spark.createDataFrame(z_rows, "feature string, mean double, std double, threshold double, "
                                             "outliers_count long, outlier_pct double"),
               {"mean": 2, "std": 2, "outlier_pct": 2})
    dist = _round(spark.createDataFrame(dist_rows, "feature string, count long, null_count long, min double, "
                                                   "max double, mean double, median double, std double, "
                                                   "skewness double, kurtosis double"),
                  {c: 4 for c in ("min", "max", "mean", "median", "std", "skewness", "kurtosis")})
    corr_rows = []
    if len(nums) >= 2:
        # pass 5: centred sums with the pass-1 means (one more cheap aggregate)
        miss_of = {c: bool(r[f"m{cols.index(c)}"]) for c in nums}
        rr = _pearson_pairs(df, nums, [(i, j) for i in range(len(nums)) for j in range(i + 1, len(nums))],
                            means=[r[f"a{i}"] for i in range(len(nums))], gaps=[miss_of[c] for c in nums])
        for i, a in enumerate(nums):
            for j, b in enumerate(nums):
                if i == j:
                    s = r[f"s{i}"]
                    v = 1.0 if s and not math.isnan(s) and r[f"c{i}"] > 1 else None
                else:
                    v = rr[(min(i, j), max(i, j))]
                corr_rows.append((a, b, i, j, v))
    corr_exact = spark.createDataFrame(corr_rows, "feature_1 string, feature_2 string, idx_1 int, idx_2 int, r double")
    corr = corr_exact.withColumn("r", F.round("r", 3))
    if cat_top is None:
        cat_top = spark.createDataFrame([], "feature string, top_value string, top_count long, top_pct double")
    out = Profile(n, nums, cats, miss.cache(), gm, iqr.cache(), z.cache(), corr.cache(), corr_exact.cache(),
                  dist.cache(), cat_top.cache())
    return out
