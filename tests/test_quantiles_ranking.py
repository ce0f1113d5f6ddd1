import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tablesmith.operators.quantiles import exact_median, exact_quantiles
from tablesmith.operators.ranking import running_totals


def _frame(spark, values, name="x"):
    return spark.createDataFrame([(float(v) if v is not None else None,) for v in values], f"{name} double")


def test_quantiles_match_pandas_both_paths(spark):
    rng = np.random.default_rng(1)
    vals = np.round(rng.lognormal(3, 1, 3000), 2)  # long right tail, many ties
    df = _frame(spark, vals)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    ref = [pd.Series(vals).quantile(q) for q in probs]
    direct = exact_quantiles(df, ["x"], probs)["x"]
    refined = exact_quantiles(df, ["x"], probs, max_task_rows=50, buckets=8)["x"]
    assert np.allclose(direct, ref) and np.allclose(refined, ref)


def test_quantiles_hot_value_and_nulls(spark):
    vals = [7.0] * 1000 + list(range(500)) + [None] * 30 + [float("nan")] * 5
    df = _frame(spark, vals)
    got = exact_quantiles(df, ["x"], [0.25, 0.5, 0.75], max_task_rows=40, buckets=4)["x"]
    ref = [pd.Series([v for v in vals if v is not None]).dropna().quantile(q) for q in (0.25, 0.5, 0.75)]
    assert np.allclose(got, ref)


def test_median_fixture(spark):
    df = _frame(spark, [None, float("nan"), 1, 2, 4, 10])
    assert exact_median(df, ["x"])["x"] == 3.0


def test_all_missing_column(spark):
    df = _frame(spark, [None, None])
    assert exact_quantiles(df, ["x"], [0.5])["x"] == [None]


def test_running_totals_large_path_equals_window(spark):
    rows = [(g, float(k), 1 + (k % 3)) for g in range(3) for k in range(200)]
    t = spark.createDataFrame(rows, "g int, k double, w int")
    small = {(r.g, r.k): r.w_cum for r in running_totals(t, ["g"], ["k"], ["w"]).collect()}
    big = {(r.g, r.k): r.w_cum for r in running_totals(t, ["g"], ["k"], ["w"], max_task_rows=37).collect()}
    assert small == big
    assert small[(1, 199.0)] == sum(1 + (k % 3) for k in range(200))


def test_kendall_tau_b_matches_brute_force(spark):
    from tablesmith.operators.kendall import kendall_tau_b
    rng = np.random.default_rng(0)
    x = rng.integers(0, 15, 300).astype(float)
    y = (x * 0.3 + rng.integers(0, 8, 300)).astype(float)
    x[::13] = np.nan
    m = ~np.isnan(x)
    xx, yy = x[m], y[m]
    dx, dy = np.sign(xx[:, None] - xx[None, :]), np.sign(yy[:, None] - yy[None, :])
    iu = np.triu_indices(len(xx), 1)
    n0, n1, n2 = len(iu[0]), (dx[iu] == 0).sum(), (dy[iu] == 0).sum()
    ref = (dx * dy)[iu].sum() / np.sqrt((n0 - n1) * (n0 - n2))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    for block in (100_000, 23):  # one block, and many blocks (merge levels)
        assert abs(kendall_tau_b(df, "x", "y", block) - ref) < 1e-12
