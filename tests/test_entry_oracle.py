"""The driver contract and a sample of oracle checks at sf0.001 (the full set
runs with ``python tests/oracle_compare.py /root/testdata/sf0.01``)."""

import importlib.util
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry_mod  # noqa: E402
from oracle_compare import compare, duck_connect  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert df.columns[:2] == ["feature", "q1"] and len(rows) >= 0


def test_registry_consistent():
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 80
    from tablesmith.suite import QUERIES
    assert not [k for k in QUERIES if k.startswith("op")]  # these come from the training-data package alone
    if importlib.util.find_spec("tablesmith.llm") is None:
        assert set(q) == set(QUERIES)
    else:
        assert {k for k in q if k not in QUERIES} <= {k for k in q if k.startswith("op") or k == "pipeline"}


@pytest.mark.parametrize("name", ["p08_outliers_iqr", "p03_summary_statistics", "p11_spearman", "q07_run_all",
                                  "t11_stratified_split", "e06_roc_curve", "m02_knn", "m04_naive_bayes",
                                  "i02_confidence", "f09_fix_plan"])
def test_oracle_sample(spark, name):
    con = duck_connect(SF)
    problems, _, _ = compare(spark, con, name, entry_mod.queries()[name], entry_mod.oracle_sql()[name], SF)
    assert not problems, problems
