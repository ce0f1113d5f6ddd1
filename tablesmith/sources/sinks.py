"""Sinks: scored rows as CSV / Parquet (S7) and the run / decision log."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = "ts timestamp, type string, description string, details map<string,string>"


def write_predictions(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Distributed write (one file per partition); CSV gets a header row."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def log_decision(spark: SparkSession, path: str, kind: str, description: str, details: dict | None = None) -> None:
    """Append one entry (timestamp, type, description, details) to the log table."""
    row = (datetime.now(timezone.utc).replace(tzinfo=None), kind, description,
           {k: (v if isinstance(v, str) else json.dumps(v, default=str)) for k, v in (details or {}).items()})
    spark.createDataFrame([row], LOG_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All entries, oldest first."""
    return spark.read.schema(LOG_SCHEMA).parquet(path).orderBy("ts")


def log_frame(spark: SparkSession, entries: list[tuple[str, str, dict]]) -> DataFrame:
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    return spark.createDataFrame([(now, k, d, {a: str(b) for a, b in (x or {}).items()}) for k, d, x in entries],
                                 LOG_SCHEMA).withColumn("ord", F.monotonically_increasing_id())
