"""Paths that the test tables are too small to reach: forced with small limits and compared with the plain path."""

import math

import pytest
from pyspark.sql import functions as F

from tablesmith.functions.columns import bounded
from tablesmith.operators import correlation as C
from tablesmith.operators import evaluate as E
from tablesmith.operators import frequencies as FQ
from tablesmith.operators import prepare as T
from tablesmith.operators import profile as P
from tablesmith.operators import quality as Q
from tablesmith.operators import tuning as H
from tablesmith.operators.quantiles import exact_quantiles
from tablesmith.operators.ranking import running_totals
from tablesmith.sources.tables import read_table

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def grouped(spark):
    return spark.createDataFrame([(None if i % 4 == 0 else f"g{i % 3}", i, 1) for i in range(40)],
                                 "g string, k int, one int")


def test_running_totals_keep_null_groups(grouped):
    small = running_totals(grouped, ["g"], ["k"], ["one"])
    large = running_totals(grouped, ["g"], ["k"], ["one"], max_task_rows=5)
    assert rows_of(small) == rows_of(large.select(small.columns)) and large.count() == 40


@pytest.mark.parametrize("stratify", [True, False])
def test_split_paths(grouped, stratify):
    def split(**kw):
        return rows_of(T.train_test_split(grouped, "g", 0.25, 7, stratify, ["k"], **kw))
    plain = split()
    assert len(plain) == 40 and sum(r[-1] == "test" for r in plain) == 10
    assert plain == split(max_task_rows=2) == split(hash_digits=1) == split(hash_digits=1, max_task_rows=1)


def test_split_moves_no_rows(spark):
    """Every row is labelled where it is read."""
    li = read_table(spark, SF, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    sp = T.train_test_split(li, "l_returnflag", 0.2, 42, True, ["l_orderkey", "l_linenumber", "l_partkey"])
    plan = sp._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 0


def test_folds_spearman_roc_paths(spark):
    ev = read_table(spark, SF, "events").select("event_id", "user_id", "value", "event_type")
    assert rows_of(C.spearman(ev, ["user_id", "value"])) == rows_of(C.spearman(ev, ["user_id", "value"], max_task_rows=50))
    sc = ev.select((F.col("event_id") % 2).cast("double").alias("label"), F.col("value").alias("score"))
    assert E.roc_auc(sc).first()[0] == E.roc_auc(sc, max_task_rows=50).first()[0]
    assert rows_of(E.roc_curve(sc)) == rows_of(E.roc_curve(sc, max_task_rows=50))


def test_quantiles_narrow_and_infinite(spark):
    li = read_table(spark, SF, "lineitem")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    assert exact_quantiles(li, cols, probs) == exact_quantiles(li, cols, probs, max_task_rows=20, buckets=8)
    x = [float(i) for i in range(50)] + [math.inf, -math.inf, math.inf]
    df = spark.createDataFrame([(v,) for v in x], "v double")
    for limit in (1000, 5):
        assert exact_quantiles(df, ["v"], [0.0, 0.5, 1.0], max_task_rows=limit, buckets=8)["v"] == [
            -math.inf, sorted(x)[26], math.inf]
    only = spark.createDataFrame([(math.inf,), (-math.inf,)], "v double")
    assert exact_quantiles(only, ["v"], [0.0, 1.0], max_task_rows=1)["v"] == [-math.inf, math.inf]


def test_bounded_collect(spark):
    with pytest.raises(ValueError, match="more than 3 classes"):
        bounded(spark.range(5), "classes", 3)
    assert len(bounded(spark.range(3), "classes", 3)) == 3


def test_exact_types(spark):
    df = spark.createDataFrame([(5, 9007199254740992, "12345678901234567890.25", -1.5), (5, 9007199254740993,
                                "12345678901234567890.26", -1.5)], "c int, l long, s string, f double")
    df = df.withColumn("d", F.col("s").cast("decimal(30,2)")).withColumn("n", -F.col("d")).drop("s")
    vc = FQ.value_counts(df)
    assert {r.feature: r.distinct for r in FQ.distinct_counts(vc).collect()} == {"c": 1, "l": 2, "f": 1, "d": 2, "n": 2}
    shown = FQ.with_display_value(df, vc, df.columns).orderBy("feature", *FQ.KEYS).where("feature in ('d', 'n')").collect()
    assert [r.value for r in shown] == ["12345678901234567890.25", "12345678901234567890.26",
                                        "-12345678901234567890.26", "-12345678901234567890.25"]
    issues = {tuple(r.affected_columns): r.details["value"] for r in Q.constant_issues(df).collect()}
    assert issues == {("c",): "5", ("f",): "-1.5"}


def test_names_with_dots(spark):
    df = read_table(spark, SF, "events").select("event_id", "value", "event_type").toDF("a.b", "x `y`", "c.type")
    plain = read_table(spark, SF, "events").select("event_id", "value", "event_type")
    assert P.outliers_iqr(df).count() == P.outliers_iqr(plain).count()
    assert P.missing_values(df).count() == 3 and P.summary_statistics(df).count() == 2
    assert P.outliers_zscore(df).count() == 2 and C.pearson(df).count() == 4
    assert P.categorical_summary(df).count() == P.categorical_summary(plain).count()
    assert P.class_distribution(df, "c.type").count() == P.class_distribution(plain, "event_type").count()
    assert Q.run_all(df, target="c.type").count() == Q.run_all(plain, target="event_type").count()
    assert T.LabelMap.fit(df, "c.type").classes == T.LabelMap.fit(plain, "event_type").classes
    split = T.train_test_split(df, "c.type", 0.2, 1, True, ["a.b"])
    assert split.count() == df.count()


def test_failed_evaluation_is_a_row(spark):
    good = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "label double, prediction double")
    out = {r.model: r for r in E.evaluate_all({"good": good, "bad": good.drop("prediction")}).collect()}
    assert out["good"].error is None and out["good"].f1 == 1.0
    assert out["bad"].f1 is None and "prediction" in out["bad"].error
    assert [r.model for r in E.comparison(E.evaluate_all({"good": good, "bad": good.drop("prediction")})).collect()] == ["good"]


def test_fold_column_keeps_null_classes(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else float(i % 2)) for i in range(30)], "k int, label double")
    assert H.with_folds(df, key=["k"]).count() == 30


def test_long_texts_by_digest(spark):
    """Texts that differ behind the shared beginning, repeats, ties by count, and a short one."""
    start = "x" * (FQ.WHOLE_TEXT + 5)
    texts = [start + "b"] * 3 + [start + "a"] * 3 + [start + "c"] * 2 + ["short"] * 2 + [start] + [None]
    df = spark.createDataFrame([(t, i % 2) for i, t in enumerate(texts)], "t string, k int")
    vc = FQ.value_counts(df)
    assert {r.feature: r.distinct for r in FQ.distinct_counts(vc).collect()} == {"t": 5, "k": 2}
    assert max(len(r.ks or "") for r in vc.collect()) == FQ.WHOLE_TEXT
    got = [(r["value"], r["count"]) for r in P.categorical_summary(df, 4, ["t"]).orderBy("rank").collect()]
    assert got == [(start + "a", 3), (start + "b", 3), ("short", 2), (start + "c", 2)]
    info = {r.feature: r for r in P.column_info(df).collect()}
    assert info["t"].distinct_count == 5 and info["t"].sample_values == f"['short', '{start}"[:50]


def test_shuffled_bytes_of_long_texts_are_bounded(spark):
    """The exchange of the counts carries the beginning and the digest, never a text."""
    docs = read_table(spark, SF, "documents").select("text")
    plan = FQ.value_counts(docs)._jdf.queryExecution().executedPlan().toString()
    below = plan.split("Exchange hashpartitioning")[1]
    assert "left(" in below.lower() or "substring" in below.lower() or "md5" in below.lower()
    widest = FQ.value_counts(docs).select(F.max(F.octet_length("ks") + F.coalesce(F.octet_length("kh"), F.lit(0)))).first()[0]
    assert widest <= 4 * FQ.WHOLE_TEXT + 16


@pytest.mark.parametrize("repeats", [1, 7])
def test_split_quotas_are_exact_with_repeated_keys(spark, repeats):
    rows = [(i // repeats, ["a", "b", None][i % 3 % 2 + (i % 5 == 0)]) for i in range(420)]
    df = spark.createDataFrame(rows, "k long, y string")
    for limit in (10 ** 6, 5):
        out = T.train_test_split(df, "y", 0.2, key=["k"], max_task_rows=limit, hash_digits=1)
        n = {(r["y"], r["split"]): r["count"] for r in out.groupBy("y", "split").count().collect()}
        assert sum(n.values()) == 420 and sum(v for (_, s), v in n.items() if s == "test") == 84
        for y in ("a", "b", None):
            total = n[y, "test"] + n[y, "train"]
            assert abs(n[y, "test"] - 0.2 * total) < 1
    # a hash on both sides only where equal keys stand on the cut
    both = out.groupBy("y", "k").agg(F.countDistinct("split").alias("d")).where("d = 2").count()
    assert both <= 3 and (repeats > 1 or both == 0)


def test_split_is_one_labelling_pass(spark):
    li = read_table(spark, SF, "lineitem")
    plan = T.train_test_split(li, "l_returnflag", 0.2, 42, True, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
                               )._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "Window" not in plan


def test_inversions():
    import numpy as np

    from tablesmith.operators.kendall import _inversions
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 17, 64, 100):
        y, w = rng.integers(0, max(2, n // 2), n), rng.integers(1, 9, n)
        for scale in (1, 10 ** 10):  # small weights in 64 bits, large ones as Python numbers
            v = w * scale
            assert _inversions(y, v) == sum(int(v[i]) * int(v[j]) for i in range(n) for j in range(i + 1, n) if y[i] > y[j])


def test_spearman_with_gaps_has_a_fixed_number_of_jobs(spark):
    def jobs(columns):
        rows = [tuple(None if (i + c) % 5 == 0 else (i * (c + 3)) % 11 + 0.5 for c in range(columns)) for i in range(60)]
        df = spark.createDataFrame(rows, ", ".join(f"c{c} double" for c in range(columns)))
        spark.sparkContext.setJobGroup(f"spearman-{columns}", "")
        try:
            got = C.spearman(df)
            return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"spearman-{columns}")), got, rows
        finally:
            spark.sparkContext._jsc.clearJobGroup()
    (few, *_), (many, got, rows) = jobs(3), jobs(6)
    assert many <= few + 2
    import pandas as pd
    want = pd.DataFrame(rows).corr(method="spearman")
    for r in got.collect():
        assert abs(r["r"] - want.iloc[r["idx_1"], r["idx_2"]]) < 6e-4
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, None), (None, 3.0), (1.0, 5.0)], "a double, b double")
    assert {(r["idx_1"], r["idx_2"]): r["r"] for r in C.spearman(flat).collect()} == {(0, 0): None, (0, 1): None, (1, 0): None, (1, 1): 1.0}


def test_label_table_of_many_classes(spark):
    """100,000 classes, one of them a third of the rows: encoded, decoded, weighted; ranges as in one task."""
    from tablesmith.operators.models.catalogue import balanced_weights, balanced_weights_joined
    df = spark.range(150_000).select(F.when(F.col("id") < 50_000, 0).otherwise(F.col("id") * 3).alias("a.y"), F.col("id").alias("label"))
    lt = T.LabelTable.fit(df, "a.y", max_task_rows=30_000)
    assert lt.count() == 100_001
    both = lt.decode(lt.encode(df, "a.y", "n"), "n", "back")
    assert both.columns == ["a.y", "label", "n", "back"]
    bad = both.where((F.col("back") != F.col("`a.y`")) | F.col("back").isNull() | (F.col("n") != F.when(
        F.col("label") < 50_000, 0.0).otherwise(F.col("label") - 49_999.0)))
    assert bad.count() == 0 and both.count() == 150_000
    w = balanced_weights_joined(df, "a.y").groupBy("weight").count().collect()
    assert {(round(r["weight"], 9), r["count"]) for r in w} == {
        (round(150_000 / 100_001 / 50_000, 9), 50_000), (round(150_000 / 100_001, 9), 100_000)}
    few = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3)], "label string, id int")
    assert rows_of(balanced_weights(few).select("id", "weight")) == rows_of(balanced_weights_joined(few).select("id", "weight"))


def test_label_table_edges(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "y string")
    lt = T.LabelTable.fit(df, "y")
    assert rows_of(lt.encode(df, "y", "y2")) == rows_of(spark.createDataFrame(
        [("b", 1.0), (None, None), ("a", 0.0), ("b", 1.0)], "y string, y2 double"))
    new = spark.createDataFrame([("z",), ("a",)], "y string")
    assert sorted(lt.encode(new, "y").select("label").collect(), key=repr) == [(0.0,), (None,)]
    assert lt.decode(spark.createDataFrame([(1.0,), (7.0,), (None,)], "label double"), "label").where("class = 'b'").count() == 1
    ints = T.LabelTable.fit(spark.createDataFrame([(10,), (9,), (100,)], "y int"), "y")
    assert sorted(map(tuple, ints.table.collect())) == [(9, 0.0), (10, 1.0), (100, 2.0)]
    assert T.LabelTable.fit(df.where("false"), "y").count() == 0
