import pytest
from pyspark.sql import functions as F

from tablesmith.operators import fixes as FX
from tablesmith.operators import quality as Q
from tablesmith.operators import validate as V


@pytest.fixture(scope="module")
def table(spark):
    rows = []
    for i in range(100):
        rows.append((i, None if i % 2 == 0 else float(i), None if i % 4 == 0 else "k" + str(i % 3),
                     "same", float(i) * 2 + 1, float(i), "y" if i < 90 else "n", f"name{i}"))
    rows.append((100, 5000.0, "k1", "same", 201.0, 100.0, "y", "name100"))
    return spark.createDataFrame(rows, "id bigint, gappy double, cat string, const string, twin double, "
                                       "base double, target string, label_text string")


def test_rules(table):
    issues = Q.run_all(table, target="target").collect()
    kinds = [(i.issue_type, i.severity, tuple(i.affected_columns)) for i in issues]
    assert ("Missing Values", "Medium", ("gappy",)) in kinds or ("Missing Values", "High", ("gappy",)) in kinds
    assert ("Constant Feature", "High", ("const",)) in kinds
    assert ("High Cardinality", "Medium", ("label_text",)) in kinds
    assert any(k[0] == "Multicollinearity" and set(k[2]) >= {"twin", "base"} for k in kinds)
    assert ("Class Imbalance", "Medium", ("target",)) in kinds
    sev = [i.severity for i in issues]
    order = {"Critical": 0, "High": 1, "Medium": 2, "Low": 3}
    assert sev == sorted(sev, key=order.get)
    s = Q.issue_summary(Q.run_all(table, target="target")).first()
    assert s.total_issues == len(issues) and s.critical_count == 0


def test_fixes(table):
    mean = FX.fill_mean(table, "gappy").agg(F.count("gappy")).first()[0]
    assert mean == table.count()
    med = FX.fill_median(table, "gappy").where("id = 0").first()["gappy"]
    nn = sorted(r[0] for r in table.where("gappy is not null").select("gappy").collect())
    k = len(nn)
    assert med == (nn[(k - 1) // 2] + nn[k // 2]) / 2
    assert FX.fill_mode(table, "cat").where("id = 0").first()["cat"] == "k1"
    assert FX.drop_missing_rows(table, "cat").count() == 76
    capped = FX.cap_outliers(table, "gappy")
    assert capped.agg(F.max("gappy")).first()[0] < 5000 and capped.where("gappy is null").count() == 50
    assert FX.remove_outliers(table, "gappy").count() == 50
    res = FX.apply_plan(table, [("missing", "cat", "drop_column"), ("missing", "cat", "mode"),
                                ("outlier", "gappy", "cap")])
    assert res.columns == len(table.columns) - 1 and res.log.count() == 3
    assert "skipped" in res.log.where("ord = 1").first()["text"]
    with pytest.raises(ValueError):
        FX.fill_mean(table, "cat")


def test_validators(spark, table):
    assert V.as_tuple(V.target_ready(table, "target"))[0]
    assert not V.as_tuple(V.target_ready(table, "const"))[0]
    assert not V.as_tuple(V.target_ready(table, "gappy"))[0]
    assert not V.as_tuple(V.features_ready(table, ["target"], "target"))[0]
    assert not V.as_tuple(V.split_ratio_ok(spark, train_ratio=0.95))[0]
    small = spark.createDataFrame([("a",)] * 20 + [("b",)] * 3, "y string")
    ok, msg = V.as_tuple(V.stratify_ok(small, "y", 0.2))
    assert not ok and "needs 6" in msg
    assert V.as_tuple(V.content_ok(table))[0]
    bad = V.numeric_in_range(spark.createDataFrame([("1",), ("x",), ("99",)], "v string"), "v", 0, 10).collect()
    assert sorted(r.reason for r in bad) == ["above maximum 10", "not a number"]
