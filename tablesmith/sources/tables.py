"""Parquet scan of the test tables, plus the derived inputs the query
suite uses (each one is also written as SQL for the oracle)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; column pruning and filters reach the scan through Catalyst."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def orders_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` with missing values injected by a fixed rule (Low / Medium /
    High missing shares), the input of the missing-value operators."""
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        "o_orderkey", "o_custkey",
        F.when(k % 3 != 0, None).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(k % 7 == 0, None).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate",
        F.when(k % 4 == 0, None).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))


ORDERS_WITH_GAPS_SQL = """SELECT o_orderkey, o_custkey,
  CASE WHEN o_orderkey % 3 <> 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
  o_orderdate,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
FROM orders"""


def lineitem_with_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` plus ``l_net = l_extendedprice * (1 - l_discount)``, a column
    nearly collinear with ``l_extendedprice`` (input of P13 / Q6)."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.withColumn("l_net", F.col("l_extendedprice") * (1 - F.col("l_discount")))


LINEITEM_WITH_NET_SQL = "SELECT *, l_extendedprice * (1 - l_discount) AS l_net FROM lineitem"
