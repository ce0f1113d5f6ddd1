import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tablesmith.operators import evaluate as E
from tablesmith.operators import prepare as T


def test_split_quotas_and_disjoint(spark):
    rows = [(i, "a" if i % 10 < 7 else ("b" if i % 10 < 9 else "c")) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, y string")
    sp = T.train_test_split(df, "y", 0.2, 42, True, ["id"], max_task_rows=64)
    c = {(r.y, r.split): r["count"] for r in sp.groupBy("y", "split").count().collect()}
    assert c[("a", "test")] == 140 and c[("b", "test")] == 40 and c[("c", "test")] == 20
    again = T.train_test_split(df, "y", 0.2, 42, True, ["id"])
    assert sp.where("split = 'test'").select("id").subtract(again.where("split = 'test'").select("id")).count() == 0
    assert T.split_quotas({"a": 5, "b": 5, "c": 1}, 3) == {"a": 2, "b": 1, "c": 0}


def test_unseen_categories_and_scalers(spark):
    train = spark.createDataFrame([("b", 1.0, "p"), ("a", 2.0, "q"), ("c", 3.0, "p"), ("b", None, "q")] * 5,
                                  "s string, x double, y string")
    cfg = T.PrepConfig(target="y", features=("x", "s"), numerical_imputer="median", scaling="minmax",
                       encoding="onehot", stratify=False)
    prep = T.prepare(train, cfg)
    assert prep.feature_names == ["numerical__x", "categorical__s_a", "categorical__s_b", "categorical__s_c"]
    new = spark.createDataFrame([("z", 3.0), ("a", 0.0), (None, 1.0)], "s string, x double")
    out = [list(r[0]) for r in T.apply_to_new(prep, new).select(vector_to_array("features")).collect()]
    assert out[0][1:] == [0.0, 0.0, 0.0]            # unseen -> zeros
    assert out[2][1:] == [0.0, 1.0, 0.0]            # missing -> train mode 'b'
    cfg2 = T.PrepConfig(target="y", features=("s",), encoding="ordinal", stratify=False)
    prep2 = T.prepare(train, cfg2)
    got = [r[0][0] for r in T.apply_to_new(prep2, new).select(vector_to_array("features")).collect()]
    assert got == [-1.0, 0.0, 1.0]


def test_label_map_native_order(spark):
    df = spark.createDataFrame([(10,), (9,), (100,)], "y int")
    lm = T.LabelMap.fit(df, "y")
    assert lm.classes == [9, 10, 100]
    assert [r[0] for r in df.select(lm.encode("y")).collect()] == [1.0, 0.0, 2.0]


def test_metrics_and_confusion(spark):
    rows = [("a", "a")] * 5 + [("a", "b")] * 2 + [("b", "b")] * 3 + [("c", "a")]
    df = spark.createDataFrame(rows, "label string, prediction string")
    m = E.metrics(df).first()
    assert m.accuracy == round(8 / 11, 4) and m.recall == m.accuracy   # weighted recall = accuracy
    cm = E.confusion(df).collect()
    assert len(cm) == 9 and sum(r["count"] for r in cm) == 11
    pc = {r["class"]: r for r in E.per_class(df).collect()}
    assert pc["c"].precision == 0.0 and pc["c"].recall == 0.0 and pc["c"].support == 1


@pytest.mark.parametrize("scores,auc", [([0.1, 0.2, 0.8, 0.9], 1.0), ([0.9, 0.8, 0.2, 0.1], 0.0),
                                        ([0.5, 0.5, 0.5, 0.5], 0.5)])
def test_auc_cases(spark, scores, auc):
    df = spark.createDataFrame(list(zip([0, 0, 1, 1], scores)), "label int, score double")
    assert E.roc_auc(df).first()[0] == auc
    flipped = df.withColumn("score", 1 - F.col("score"))
    assert E.roc_auc(flipped).first()[0] == round(1 - auc, 4)


def test_roc_curve_ends(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.4), (0, 0.5), (1, 0.8)], "label int, score double")
    pts = E.roc_curve(df).collect()
    assert (pts[0].fpr, pts[0].tpr) == (0.0, 0.0) and (pts[-1].fpr, pts[-1].tpr) == (1.0, 1.0)
    big = E.roc_auc(df, max_task_rows=1).first()[0]
    assert big == E.roc_auc(df).first()[0] == 0.75
