"""Plan shape checks: pruning reaches the scan, top-k is limited before the
shuffle, filters are pushed to Parquet."""

from pyspark.sql import functions as F

from tablesmith.operators import profile as P
from tablesmith.sources.tables import read_table

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_group_limit_and_pruning(spark):
    o = read_table(spark, SF, "orders")
    plan = _plan(P.categorical_summary(o, 10, ["o_orderpriority"]))
    assert "WindowGroupLimit" in plan
    assert "o_totalprice" not in plan.split("FileScan")[1].split("ReadSchema")[1].split("\n")[0]


def test_filter_pushdown(spark):
    li = read_table(spark, SF, "lineitem")
    plan = _plan(li.where(F.col("l_quantity") > 45).select("l_orderkey"))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
