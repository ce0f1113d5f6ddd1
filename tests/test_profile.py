import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablesmith.operators import correlation as C
from tablesmith.operators import profile as P
from tablesmith.plans.full_profile import full_profile


@pytest.fixture(scope="module")
def nulls(spark):
    return spark.createDataFrame([(1, None, "a"), (2, float("nan"), "b"), (3, 1.0, None), (4, 2.0, "a"),
                                  (5, 4.0, "b"), (6, 10.0, "a")], "id bigint, x double, s string")


def test_missing_values_counts_nan_as_missing(nulls):
    m = {r.feature: r for r in P.missing_values(nulls).collect()}
    assert m["x"].missing_count == 2 and m["x"].missing_pct == 33.33
    assert m["s"].missing_count == 1 and m["id"].missing_count == 0
    assert P.global_missing_pct(nulls).first()[0] == round(3 * 100 / 18, 2)


def test_distribution_nulls_frame(nulls):
    d = {r.feature: r for r in P.numeric_distribution(nulls).collect()}
    assert d["x"].mean == 4.25 and d["x"].median == 3.0


def test_distribution_matches_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.exponential(2, 400), "b": rng.normal(0, 1, 400)})
    df = spark.createDataFrame(pdf)
    d = {r.feature: r for r in P.numeric_distribution(df).collect()}
    for c in "ab":
        assert d[c].skewness == pytest.approx(round(pdf[c].skew(), 4), abs=1e-4)
        assert d[c].kurtosis == pytest.approx(round(pdf[c].kurt(), 4), abs=1e-4)
        assert d[c].median == pytest.approx(round(pdf[c].median(), 4), abs=1e-4)


def test_constant_and_single(spark):
    const = spark.createDataFrame([(5.0, 1.0), (5.0, 2.0), (5.0, 4.0)], "a double, b double")
    d = {r.feature: r for r in P.numeric_distribution(const).collect()}
    assert d["a"].skewness == 0.0 and d["a"].std == 0.0
    r = {(x.feature_1, x.feature_2): x.r for x in C.pearson(const).collect()}
    assert r[("a", "b")] is None
    single = spark.createDataFrame([(1.0,)], "a double")
    s = P.summary_statistics(single).first()
    assert s["std"] is None and s["q50"] == 1.0


def test_outliers_iqr_matches_pandas(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(50, 5, 500), [200, 210, -90]])
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    o = P.outliers_iqr(df).first()
    q1, q3 = np.quantile(x, [0.25, 0.75])
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    assert o.outliers_low == int((x < lo).sum()) and o.outliers_high == int((x > hi).sum())
    z = P.outliers_zscore(df).first()
    assert z.outliers_count == int((np.abs((x - x.mean()) / x.std(ddof=1)) > 3).sum())


def test_pearson_spearman_pairwise_complete(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"a": rng.normal(0, 1, 300), "b": rng.normal(0, 1, 300)})
    pdf["c"] = pdf["a"] * 2 + rng.normal(0, 0.1, 300)
    pdf.loc[::7, "b"] = np.nan
    pdf.loc[::11, "c"] = np.nan
    df = spark.createDataFrame(pdf)
    for method in ("pearson", "spearman"):
        got = {(r.feature_1, r.feature_2): r.r for r in C.correlation(df, method).collect()}
        ref = pdf.corr(method=method).round(3)
        for a in "abc":
            for b in "abc":
                assert got[(a, b)] == pytest.approx(ref.loc[a, b], abs=1.5e-3), (method, a, b)


def test_high_correlation_pairs(spark):
    pdf = pd.DataFrame({"a": np.arange(50.0), "b": np.arange(50.0) * 3 + 1, "c": np.sin(np.arange(50.0))})
    pairs = C.high_correlation_pairs(C.pearson(spark.createDataFrame(pdf)), 0.95).collect()
    assert [(p.feature_1, p.feature_2) for p in pairs] == [("a", "b")]


def test_semantic_types(spark):
    rows = [(i, i % 2, i % 5, i * 0.37, f"c{i % 3}", f"u{i}", "x" if i % 2 else "y") for i in range(100)]
    df = spark.createDataFrame(rows, "row_id bigint, flag int, small int, cont double, cat string, uniq string, "
                                     "two string").withColumn("when", F.current_timestamp())
    t = {r.feature: r.inferred_type for r in P.semantic_types(df).collect()}
    assert t == {"row_id": "id", "flag": "binary", "small": "numeric_discrete", "cont": "id", "cat": "categorical",
                 "uniq": "id", "two": "binary", "when": "datetime"}


def test_top_k_ties_smaller_value_first(spark):
    df = spark.createDataFrame([(v,) for v in "babac"], "x string")
    top = P.categorical_summary(df, 2).collect()
    assert [(r["value"], r["count"]) for r in top] == [("a", 2), ("b", 2)]


def test_histogram_max_in_last_bin(spark):
    df = spark.createDataFrame([(float(v),) for v in range(31)], "x double")
    h = P.histogram(df, "x", 30).collect()
    assert len(h) == 30 and sum(r["count"] for r in h) == 31 and h[-1]["count"] == 2


def test_full_profile_agrees_with_operators(spark, nulls):
    prof = full_profile(nulls)
    a = {r.feature: tuple(r) for r in prof.outliers_iqr.collect()}
    b = {r.feature: tuple(r) for r in P.outliers_iqr(nulls).collect()}
    assert a == b
    assert math.isclose(prof.global_missing_pct, P.global_missing_pct(nulls).first()[0])


def test_bools_excluded_from_profiling_but_features(spark):
    from tablesmith.functions.columns import feature_column_types, numeric_columns
    from tablesmith.operators import prepare as T
    df = spark.createDataFrame([(True, "x"), (False, "y"), (True, "x"), (False, "y")] * 3, "b boolean, y string")
    assert numeric_columns(df) == [] and P.outliers_iqr(df).count() == 0
    assert feature_column_types(df, ["b"]) == (["b"], [])
    prep = T.prepare(df.withColumn("k", F.monotonically_increasing_id()),
                     T.PrepConfig(target="y", features=("b",), scaling="none", stratify=False, key=("k",)))
    from pyspark.ml.functions import vector_to_array
    vals = {r[0][0] for r in prep.train.select(vector_to_array("features")).collect()}
    assert vals <= {0.0, 1.0}


def test_density_equals_the_kernel_sum(spark):
    """Sub-bin moments against the sum over all rows, with a far outlier, ties and missing values."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=500), rng.exponential(3.0, size=300), [2.0] * 50, [400.0]])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
    got = P.density_curve(df, "x", 101, 1.5, 20).collect()
    h = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min() - 1.5 * h, x.max() + 1.5 * h, 101)
    want = np.exp(-0.5 * ((grid[:, None] - x[None, :]) / h) ** 2).sum(axis=1) / (len(x) * h * np.sqrt(2 * np.pi))
    assert np.abs(np.array([r.density for r in got]) - want).max() < 6e-9  # rounded to eight places
    assert [r.point for r in got] == list(range(101))
    exact = dict(P._density_sums(df.where("x < 1000"), float(x.min()), float(h), grid.tolist()).collect())
    assert max(abs(exact[i] - w * len(x) * h * np.sqrt(2 * np.pi)) for i, w in enumerate(want)) < 1e-9
    for rows in ([], [(None,)], [(1.0,)], [(3.0,), (3.0,)], [(1.0,), (float("inf"),)]):
        assert P.density_curve(spark.createDataFrame(rows, "x double"), "x").collect() == []


def test_density_cost_is_per_sub_bin(spark):
    """Rows are summed per sub-bin in the JVM before Python sees them."""
    df = spark.range(20_000).select((F.col("id") % 997).cast("double").alias("x"))
    plan = P._density_sums(df, 0.0, 50.0, [1.0, 2.0])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInPandas") < plan.index("HashAggregate(keys=[bin")
