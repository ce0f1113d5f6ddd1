"""Profiling aggregations (P1-P20) and result-table helpers.

Shape of every operator: one wide ``agg`` over the input (map-side partial
aggregation, a single tiny row to merge), reshaped with ``inline`` into a long
table keyed by ``feature``. Quantiles come from the bounded exact selector in
``quantiles``; distinct counts / top values from the shared value-count table
in ``frequencies``. No per-column job loops.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (col, as_double, categorical_columns, field_type, is_datetime,
                                 is_integral, is_missing, is_numeric, numeric_columns, type_name)
from ..functions.stats import pct, safe_div, sample_kurtosis, sample_skewness
from . import frequencies as fq
from .quantiles import column_extent, exact_quantiles


def _long(one_row: DataFrame, rows: list[Column]) -> DataFrame:
    """Turn a one-row aggregate into one row per feature via ``inline``."""
    return one_row.select(F.inline(F.array(*rows)))


def _empty(spark, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


# --------------------------------------------------------------------- P1
def missing_values(df: DataFrame) -> DataFrame:
    """Feature, missing_count, missing_pct (of all rows, 2 dp), dtype;
    sorted by missing_pct desc then column position."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.sum(is_missing(df, c).cast("long")).alias(f"_m{i}") for i, c in enumerate(cols)])
    rows = [F.struct(F.lit(c).alias("feature"),
                     F.coalesce(F.col(f"_m{i}"), F.lit(0)).cast("long").alias("missing_count"),
                     pct(F.col(f"_m{i}"), F.col("_n")).alias("missing_pct"),
                     F.lit(type_name(field_type(df, c))).alias("dtype"),
                     F.lit(i).alias("ord"))
            for i, c in enumerate(cols)]
    out = _long(agg, rows).withColumn("missing_pct", F.coalesce("missing_pct", F.lit(0.0)))
    return out.orderBy(F.desc("missing_pct"), "ord").drop("ord")


def global_missing_pct(df: DataFrame) -> DataFrame:
    """Missing cells / all cells, as one row ``global_missing_pct`` (2 dp)."""
    cols = df.columns
    if not cols:
        return _empty(df.sparkSession, "global_missing_pct double")
    missing = sum((is_missing(df, c).cast("long") for c in cols), F.lit(0).cast("long"))
    return df.agg(F.coalesce(pct(F.sum(missing), F.count(F.lit(1)) * len(cols)), F.lit(0.0))
                  .alias("global_missing_pct"))


# --------------------------------------------------------------------- P2
def column_info(df: DataFrame) -> DataFrame:
    """Per column dtype, non-null / null counts, null %, distinct count,
    three smallest distinct values as text (cut to 50 chars) and, for numeric
    columns, mean / std / min / max (2 dp for mean and std)."""
    cols = fq.profiled_columns(df)
    nums = set(numeric_columns(df))
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        aggs.append(F.sum(is_missing(df, c).cast("long")).alias(f"_m{i}"))
        if c in nums:
            v = as_double(df, c)
            aggs += [F.avg(v).alias(f"_a{i}"), F.stddev_samp(v).alias(f"_s{i}"),
                     F.min(v).alias(f"_lo{i}"), F.max(v).alias(f"_hi{i}")]
    agg = df.agg(*aggs)
    null_d = F.lit(None).cast("double")
    rows = []
    for i, c in enumerate(cols):
        num = c in nums
        rows.append(F.struct(
            F.lit(c).alias("feature"), F.lit(i).alias("ord"),
            F.lit(type_name(field_type(df, c))).alias("dtype"),
            (F.col("_n") - F.col(f"_m{i}")).cast("long").alias("non_null_count"),
            F.col(f"_m{i}").cast("long").alias("null_count"),
            F.coalesce(pct(F.col(f"_m{i}"), F.col("_n")), F.lit(0.0)).alias("null_pct"),
            (F.round(F.col(f"_a{i}"), 2) if num else null_d).alias("mean"),
            (F.round(F.col(f"_s{i}"), 2) if num else null_d).alias("std"),
            (F.col(f"_lo{i}") if num else null_d).alias("min"),
            (F.col(f"_hi{i}") if num else null_d).alias("max")))
    base = _long(agg, rows)
    vc = fq.value_counts(df, cols)
    dist = fq.distinct_counts(vc)
    quoted = F.when(F.col("feature").isin(categorical_columns(df)),
                    F.concat(F.lit("'"), F.col("value"), F.lit("'"))).otherwise(F.col("value"))
    samples = (fq.top_k(df, vc, 3, cols, by_count=False).withColumn("shown", quoted)
               .groupBy("feature")
               .agg(F.array_sort(F.collect_list(F.struct("rank", "shown"))).alias("_s")))
    samples = samples.select("feature", F.substring(
        F.concat(F.lit("["), F.array_join(F.transform("_s", lambda s: s["shown"]), ", "), F.lit("]")),
        1, 50).alias("sample_values"))
    out = (base.join(dist, "feature", "left").join(samples, "feature", "left")
           .withColumn("distinct_count", F.coalesce(F.col("distinct"), F.lit(0)).cast("long"))
           .withColumn("sample_values", F.coalesce("sample_values", F.lit("[]"))))
    return out.orderBy("ord").select("feature", "dtype", "non_null_count", "null_count", "null_pct",
                                     "distinct_count", "sample_values", "mean", "std", "min", "max")


# --------------------------------------------------------------------- P3
def summary_statistics(df: DataFrame, columns: list[str] | None = None, **qkw) -> DataFrame:
    """P3 (describe): count, mean, std, min, 25/50/75 %, max; numeric only; 2 dp.
    Quartiles are exact (linear interpolation)."""
    cols = columns if columns is not None else numeric_columns(df)
    if not cols:
        return _empty(df.sparkSession, "feature string, count long, mean double, std double, min double, "
                                       "q25 double, q50 double, q75 double, max double")
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75], **qkw)
    aggs = []
    for i, c in enumerate(cols):
        v = as_double(df, c)
        aggs += [F.count(v).alias(f"_c{i}"), F.avg(v).alias(f"_a{i}"), F.stddev_samp(v).alias(f"_s{i}"),
                 F.min(v).alias(f"_lo{i}"), F.max(v).alias(f"_hi{i}")]
    agg = df.agg(*aggs)
    lit = lambda x: F.lit(x).cast("double")
    rows = [F.struct(F.lit(c).alias("feature"), F.lit(i).alias("ord"),
                     F.col(f"_c{i}").cast("long").alias("count"),
                     F.round(F.col(f"_a{i}"), 2).alias("mean"), F.round(F.col(f"_s{i}"), 2).alias("std"),
                     F.round(F.col(f"_lo{i}"), 2).alias("min"),
                     F.round(lit(q[c][0]), 2).alias("q25"), F.round(lit(q[c][1]), 2).alias("q50"),
                     F.round(lit(q[c][2]), 2).alias("q75"),
                     F.round(F.col(f"_hi{i}"), 2).alias("max"))
            for i, c in enumerate(cols)]
    return _long(agg, rows).orderBy("ord").drop("ord")


# --------------------------------------------------------------------- P4 / P7 / R7
def categorical_summary(df: DataFrame, k: int = 10, columns: list[str] | None = None) -> DataFrame:
    """Top-k values per text column by count (ties: smaller value first),
    with % of all rows (2 dp). Columns: feature, rank, value, count, pct."""
    cols = columns if columns is not None else categorical_columns(df)
    if not cols:
        return _empty(df.sparkSession, "feature string, rank int, value string, count long, pct double")
    n = df.count()
    return (fq.top_k(df, fq.value_counts(df, cols), k, cols)
            .select("feature", F.col("rank").cast("int").alias("rank"), "value",
                    F.col("cnt").cast("long").alias("count"), pct(F.col("cnt"), F.lit(n)).alias("pct"))
            .orderBy("feature", "rank"))


def categorical_distribution(df: DataFrame) -> DataFrame:
    """Top value, its count, its % of all rows, per text column."""
    top = categorical_summary(df, 1)
    return top.select("feature", F.col("value").alias("top_value"), F.col("count").alias("top_count"),
                      F.col("pct").alias("top_pct"))


def top_categories(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """value_counts().head(k) of one column: value, count."""
    return (categorical_summary(df, k, [column]) if isinstance(field_type(df, column), T.StringType)
            else _top_any(df, column, k))


def _top_any(df: DataFrame, column: str, k: int) -> DataFrame:
    n = df.count()
    return (fq.top_k(df, fq.value_counts(df, [column]), k, [column])
            .select("feature", F.col("rank").cast("int").alias("rank"), "value",
                    F.col("cnt").cast("long").alias("count"), pct(F.col("cnt"), F.lit(n)).alias("pct"))
            .orderBy("rank"))


# --------------------------------------------------------------------- P5
def distinct_table(df: DataFrame, cols: list[str], approx_rsd: float | None = None) -> DataFrame:
    """(feature, distinct): exact from the value-count shuffle, or with
    ``approx_rsd`` one pass of HyperLogLog++ sketches (no shuffle of values)."""
    if approx_rsd is None:
        return fq.distinct_counts(fq.value_counts(df, cols))
    one = df.agg(*[F.approx_count_distinct(col(c), approx_rsd).alias(f"d{i}") for i, c in enumerate(cols)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"d{i}").cast("long")
                                                  .alias("distinct")) for i, c in enumerate(cols)])))


def semantic_types(df: DataFrame, approx_rsd: float | None = None) -> DataFrame:
    """P5: feature, dtype, distinct, rows, inferred_type in
    {datetime, id, binary, numeric_discrete, numeric_continuous, categorical}.
    ``approx_rsd`` opts into approximate distinct counts (exact by default)."""
    cols = fq.profiled_columns(df)
    dist = distinct_table(df, cols, approx_rsd)
    n = df.count()
    meta = df.sparkSession.createDataFrame(
        [(c, i, type_name(field_type(df, c)), is_datetime(field_type(df, c)),
          is_numeric(field_type(df, c)) or isinstance(field_type(df, c), T.BooleanType),
          is_integral(field_type(df, c)) or isinstance(field_type(df, c), T.BooleanType),
          "id" in c.lower()) for i, c in enumerate(cols)],
        "feature string, ord int, dtype string, is_dt boolean, is_num boolean, is_int boolean, has_id boolean")
    t = (meta.join(dist, "feature", "left").withColumn("rows", F.lit(n).cast("long"))
         .withColumn("distinct", F.coalesce("distinct", F.lit(0)).cast("long")))
    d, r = F.col("distinct"), F.col("rows")
    ratio = safe_div(d.cast("double"), r.cast("double"))
    inferred = (F.when(F.col("is_dt"), "datetime")
                .when(F.col("is_num") & ((d == r) | ((ratio > 0.95) & F.col("has_id"))), "id")
                .when(F.col("is_num") & (d == 2), "binary")
                .when(F.col("is_num") & ((d <= 20) | (F.col("is_int") & (ratio < 0.05))), "numeric_discrete")
                .when(F.col("is_num"), "numeric_continuous")
                .when(d == 2, "binary")
                .when(d == r, "id")
                .otherwise("categorical"))
    return (t.withColumn("inferred_type", inferred).orderBy("ord")
            .select("feature", "dtype", "distinct", "rows", "inferred_type"))


# --------------------------------------------------------------------- P6
def numeric_distribution(df: DataFrame, columns: list[str] | None = None, **qkw) -> DataFrame:
    """Min, max, mean, median (exact), std, bias-corrected skewness and
    excess kurtosis (0 when n <= 2 / n <= 3); 4 dp."""
    cols = columns if columns is not None else numeric_columns(df)
    if not cols:
        return _empty(df.sparkSession, "feature string, count long, null_count long, min double, max double, "
                                       "mean double, median double, std double, skewness double, kurtosis double")
    med = exact_quantiles(df, cols, [0.5], **qkw)
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        v = as_double(df, c)
        aggs += [F.count(v).alias(f"_c{i}"), F.min(v).alias(f"_lo{i}"), F.max(v).alias(f"_hi{i}"),
                 F.avg(v).alias(f"_a{i}"), F.stddev_samp(v).alias(f"_s{i}"),
                 F.skewness(v).alias(f"_g1{i}"), F.kurtosis(v).alias(f"_g2{i}")]
    agg = df.agg(*aggs)
    r4 = lambda e: F.round(e, 4)
    rows = []
    for i, c in enumerate(cols):
        n = F.col(f"_c{i}").cast("double")
        rows.append(F.struct(
            F.lit(c).alias("feature"), F.lit(i).alias("ord"),
            F.col("_n").cast("long").alias("count"), (F.col("_n") - F.col(f"_c{i}")).cast("long").alias("null_count"),
            r4(F.col(f"_lo{i}")).alias("min"), r4(F.col(f"_hi{i}")).alias("max"),
            r4(F.col(f"_a{i}")).alias("mean"), r4(F.lit(med[c][0]).cast("double")).alias("median"),
            r4(F.col(f"_s{i}")).alias("std"),
            F.when(n > 0, r4(sample_skewness(n, F.col(f"_g1{i}")))).alias("skewness"),
            F.when(n > 0, r4(sample_kurtosis(n, F.col(f"_g2{i}")))).alias("kurtosis")))
    return _long(agg, rows).orderBy("ord").drop("ord")


# --------------------------------------------------------------------- P8
def outliers_iqr(df: DataFrame, columns: list[str] | None = None, **qkw) -> DataFrame:
    """Q1, Q3, IQR, bounds at 1.5 IQR (2 dp), strict low/high/total counts,
    % of non-missing rows. All-missing columns are skipped. Bounds are exact
    quartiles; counting is one more wide pass with the bounds as literals."""
    cols = columns if columns is not None else numeric_columns(df)
    ext = column_extent(df, cols) if cols else {}
    cols = [c for c in cols if ext[c][0]]
    if not cols:
        return _empty(df.sparkSession, "feature string, q1 double, q3 double, iqr double, lower_bound double, "
                                       "upper_bound double, outliers_low long, outliers_high long, "
                                       "total_outliers long, outlier_pct double")
    q = exact_quantiles(df, cols, [0.25, 0.75], extent=ext, **qkw)
    bounds = iqr_bounds(q)
    aggs = []
    for i, c in enumerate(cols):
        v = as_double(df, c)
        lo, hi = bounds[c][2], bounds[c][3]
        aggs += [F.count(F.when(v < F.lit(lo), 1)).alias(f"_l{i}"),
                 F.count(F.when(v > F.lit(hi), 1)).alias(f"_h{i}")]
    agg = df.agg(*aggs)
    r2 = lambda x: F.round(F.lit(x).cast("double"), 2)
    rows = []
    for i, c in enumerate(cols):
        q1, q3, lo, hi = bounds[c]
        total = F.col(f"_l{i}") + F.col(f"_h{i}")
        rows.append(F.struct(
            F.lit(c).alias("feature"), F.lit(i).alias("ord"),
            r2(q1).alias("q1"), r2(q3).alias("q3"), r2(q3 - q1).alias("iqr"),
            r2(lo).alias("lower_bound"), r2(hi).alias("upper_bound"),
            F.col(f"_l{i}").cast("long").alias("outliers_low"), F.col(f"_h{i}").cast("long").alias("outliers_high"),
            total.cast("long").alias("total_outliers"),
            F.round(total * 100.0 / F.lit(float(ext[c][0])), 2).alias("outlier_pct")))
    return _long(agg, rows).orderBy("ord").drop("ord")


def iqr_bounds(quartiles: dict[str, list[float]]) -> dict[str, tuple[float, float, float, float]]:
    """(q1, q3, lower, upper) with the 1.5 IQR fences."""
    out = {}
    for c, (q1, q3) in quartiles.items():
        iqr = q3 - q1
        out[c] = (q1, q3, q1 - 1.5 * iqr, q3 + 1.5 * iqr)
    return out


# --------------------------------------------------------------------- P9
def outliers_zscore(df: DataFrame, columns: list[str] | None = None, threshold: float = 3.0) -> DataFrame:
    """|x - mean| / std > threshold with the sample std; std 0 gives no
    outliers. Two passes: moments, then a conditional count with literals."""
    cols = columns if columns is not None else numeric_columns(df)
    if not cols:
        return _empty(df.sparkSession, "feature string, mean double, std double, threshold double, "
                                       "outliers_count long, outlier_pct double")
    aggs = []
    for i, c in enumerate(cols):
        v = as_double(df, c)
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"a{i}"), F.stddev_samp(v).alias(f"s{i}")]
    m = df.agg(*aggs).first()
    keep = [(i, c) for i, c in enumerate(cols) if m[f"n{i}"]]
    counts = []
    for i, c in keep:
        s = m[f"s{i}"]
        if s is None or s == 0 or math.isnan(s):
            counts.append(F.lit(0).cast("long").alias(f"_o{i}"))
        else:
            z = F.abs((as_double(df, c) - F.lit(m[f"a{i}"])) / F.lit(s))
            counts.append(F.count(F.when(z > F.lit(threshold), 1)).alias(f"_o{i}"))
    agg = df.agg(*counts) if counts else df.agg(F.count(F.lit(1)).alias("_unused"))
    rows = []
    for i, c in keep:
        s = m[f"s{i}"]
        std_out = 0.0 if s == 0 else s
        rows.append(F.struct(
            F.lit(c).alias("feature"), F.lit(i).alias("ord"),
            F.round(F.lit(m[f"a{i}"]).cast("double"), 2).alias("mean"),
            F.round(F.lit(std_out).cast("double"), 2).alias("std"),
            F.lit(float(threshold)).alias("threshold"),
            F.col(f"_o{i}").cast("long").alias("outliers_count"),
            F.round(F.col(f"_o{i}") * 100.0 / F.lit(float(m[f"n{i}"])), 2).alias("outlier_pct")))
    if not rows:
        return _empty(df.sparkSession, "feature string, mean double, std double, threshold double, "
                                       "outliers_count long, outlier_pct double")
    return _long(agg, rows).orderBy("ord").drop("ord")


# --------------------------------------------------------------------- P15
def split_preview(df: DataFrame, train_ratio: float = 0.8) -> DataFrame:
    """total_rows, train_rows = floor(n * ratio), test_rows, train_pct, test_pct."""
    n = F.count(F.lit(1))
    return df.agg(n.cast("long").alias("total_rows")).select(
        "total_rows",
        F.floor(F.col("total_rows") * F.lit(train_ratio)).cast("long").alias("train_rows"),
        (F.col("total_rows") - F.floor(F.col("total_rows") * F.lit(train_ratio))).cast("long").alias("test_rows"),
        F.round(F.lit(train_ratio * 100), 1).alias("train_pct"),
        F.round(F.lit((1 - train_ratio) * 100), 1).alias("test_pct"))


# --------------------------------------------------------------------- P16 / P17
def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins over [min, max] (the maximum goes to the last bin;
    a constant column uses [x - .5, x + .5]); empty bins are listed with 0."""
    v = as_double(df, column)
    m = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    spark = df.sparkSession
    if m["lo"] is None:
        return _empty(spark, "bin int, lower double, upper double, count long")
    lo, hi = m["lo"], m["hi"]
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    grid = grid.select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lower"),
                       (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("upper"))
    idx = F.least(F.floor((F.col("x") - F.lit(lo)) * bins / F.lit(hi - lo)).cast("int"), F.lit(bins - 1))
    counts = (df.select(v.alias("x")).where(F.col("x").isNotNull())
              .groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("count")))
    return (grid.join(counts, "bin", "left")
            .select(F.col("bin").cast("int").alias("bin"), F.round("lower", 4).alias("lower"),
                    F.round("upper", 4).alias("upper"),
                    F.coalesce("count", F.lit(0)).cast("long").alias("count"))
            .orderBy("bin"))


DENSITY_ORDER = 10          # moments of a sub-bin
DENSITY_STEP = 0.25         # width of a sub-bin in bandwidths


def density_curve(df: DataFrame, column: str, gridsize: int = 200, cut: float = 0.0,
                  bins: int = 30) -> DataFrame:
    """Gaussian KDE with Scott's bandwidth (std * n^-1/5) on ``gridsize``
    points over [min - cut*h, max + cut*h].
    ``count_scaled`` is the density scaled to the histogram (n * bin width).

    A row only adds the powers of its offset to the moments of one sub-bin, so its cost does not depend on the grid
    and the rows are summed before the shuffle. The kernel is then expanded around the centres of the sub-bins
    (``_density_sums``): with offsets of at most h/8 and ten moments, the density is off by less than 1e-12 of
    a kernel's peak. Missing values count nothing; no value, no spread or an infinite value gives an empty curve."""
    v = as_double(df, column)
    m = df.agg(F.count(v).alias("n"), F.stddev_samp(v).alias("s"), F.min(v).alias("lo"),
               F.max(v).alias("hi")).first()
    n, s, lo, hi = m["n"], m["s"], m["lo"], m["hi"]
    if not n or not s or not math.isfinite(s):
        return _empty(df.sparkSession, "point int, x double, density double, count_scaled double")
    h = s * n ** (-0.2)
    a, b = lo - cut * h, hi + cut * h
    xs = [a + (b - a) * i / max(1, gridsize - 1) for i in range(gridsize)]
    sums = _density_sums(df.select(v.alias("x")).where(F.col("x").isNotNull()), lo, h, xs)
    grid = df.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "point long, x double")
    norm = 1.0 / (n * h * math.sqrt(2 * math.pi))
    width = (hi - lo) / bins
    out = grid.join(sums, "point").withColumn("density", F.col("k") * F.lit(norm))
    return out.select(F.col("point").cast("int").alias("point"), F.round("x", 4).alias("x"),
                      F.round("density", 8).alias("density"),
                      F.round(F.col("density") * F.lit(n * width), 4).alias("count_scaled")).orderBy("point")


def _density_sums(values: DataFrame, lo: float, h: float, xs: list[float]) -> DataFrame:
    """(point, k): sum of exp(-((xs[point] - x) / h)^2 / 2) over the rows of ``values`` (x).

    With t = (xs[point] - centre) / h and u = (x - centre) / h, a row's kernel is the Taylor series
    sum of He_j(t) exp(-t^2 / 2) u^j / j!, so a sub-bin needs only its sums of u^j."""
    import numpy as np
    import pandas as pd

    at = (F.col("x") - F.lit(lo)) / F.lit(h * DENSITY_STEP)
    binned = values.select(F.floor(at).alias("bin"), ((at - F.floor(at) - 0.5) * DENSITY_STEP).alias("u"))
    power, moments = F.lit(1.0), []
    for j in range(DENSITY_ORDER):
        moments.append(F.sum(power).alias(f"m{j}"))
        power = power * F.col("u")
    sub_bins = binned.groupBy("bin").agg(*moments)
    points = np.array(xs)

    def partial_sums(batches):
        acc = np.zeros(len(points))
        for pdf in batches:
            for start in range(0, len(pdf), 4096):
                part = pdf.iloc[start:start + 4096]
                centre = lo + (part["bin"].to_numpy(dtype=np.float64) + 0.5) * (h * DENSITY_STEP)
                t = (points[None, :] - centre[:, None]) / h
                before, now, series = np.zeros_like(t), np.ones_like(t), np.zeros_like(t)
                for j in range(DENSITY_ORDER):
                    series += now * (part[f"m{j}"].to_numpy()[:, None] / math.factorial(j))
                    before, now = now, t * now - j * before
                acc += (series * np.exp(-0.5 * t * t)).sum(axis=0)
        yield pd.DataFrame({"point": np.arange(len(points), dtype=np.int64), "k": acc})

    return (sub_bins.mapInPandas(partial_sums, "point long, k double")
            .groupBy("point").agg(F.sum("k").alias("k")))


# --------------------------------------------------------------------- P18 / P19 / P20
def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """Class (as text), count, % of rows (2 dp); count desc, class asc."""
    counts = df.groupBy(col(target).alias("_cls")).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy())  # one row per class: bounded
    return (counts
            .select(F.col("_cls").cast("string").alias("class"), F.col("count").cast("long").alias("count"),
                    pct(F.col("count"), total).alias("pct"), F.col("_cls"))
            .orderBy(F.desc("count"), "_cls").drop("_cls"))


def missing_bands(missing: DataFrame) -> DataFrame:
    """Columns with missing > 0, ascending by %, banded >50 / >20 / else."""
    return (missing.where(F.col("missing_pct") > 0)
            .select("feature", "missing_pct",
                    F.when(F.col("missing_pct") > 50, ">50%").when(F.col("missing_pct") > 20, ">20%")
                    .otherwise("<=20%").alias("band"))
            .orderBy("missing_pct", "feature"))


def overview_counts(df: DataFrame) -> DataFrame:
    """P20: rows, columns, numeric columns, categorical columns."""
    return df.agg(F.count(F.lit(1)).cast("long").alias("rows")).select(
        "rows", F.lit(len(df.columns)).cast("long").alias("columns"),
        F.lit(len(numeric_columns(df))).cast("long").alias("numeric_columns"),
        F.lit(len(categorical_columns(df))).cast("long").alias("categorical_columns"))


# --------------------------------------------------------------------- R4 / R5
def preview(df: DataFrame, n: int = 5, order_by: list[str] | None = None, tail: bool = False) -> DataFrame:
    """First / last n rows in an explicit order (Spark rows have no file order)."""
    if not 1 <= n <= 10_000:
        raise ValueError("n must be between 1 and 10000")
    keys = order_by or df.columns[:1]
    order = [F.col(k).desc() if tail else F.col(k).asc() for k in keys]
    return df.orderBy(*order).limit(n)


def rows_with_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows where any of the given (default: all) columns is missing."""
    cols = columns or df.columns
    cond = None
    for c in cols:
        e = is_missing(df, c)
        cond = e if cond is None else (cond | e)
    return df.where(cond)
