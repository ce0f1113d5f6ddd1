"""Score rows as they arrive. The fitted preparation and a model whose
transform is a projection (naive Bayes, trees, linear models) are applied to
a ``readStream`` DataFrame; the query is stateless and runs in append mode,
so each micro-batch is scored independently and exactly once per checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.prepare import Prepared
from ..operators.score import score


def source(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """A file stream over ``path`` (a folder, or a glob) with a fixed schema."""
    r = spark.readStream.format(fmt).schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


def start_scoring(prep: Prepared, model, stream: DataFrame, out_path: str, checkpoint: str,
                  keep: list[str] | None = None, fmt: str = "parquet", available_now: bool = True) -> StreamingQuery:
    """Start the scoring query; output rows are appended to ``out_path``.
    ``checkpoint`` must be a shared, durable folder on a cluster."""
    scored = score(prep, model, stream, keep)
    w = (scored.writeStream.format(fmt).outputMode("append").option("path", out_path)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
