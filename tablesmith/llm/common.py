"""Column expressions and storage helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.session import ensure_checkpoint_dir

#: a word is a run of anything but these six ASCII white-space characters
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder of the cluster."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, so
    a lost executor costs a re-read and never a recomputation of the scan."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ARROW_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in Arrow batches of at most ARROW_ROWS rows (a session
    setting, only ever lowered), so a worker holds a few megabytes of text at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """The words of a text in order."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _running(values: Column) -> Column:
    return F.aggregate(values, F.array().cast("array<int>"), lambda acc, v: F.concat(
        acc, F.array(v + F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)))))


def running_sums(values: Column, block: int = 128) -> Column:
    """Inclusive running sums of an int array. Appending copies the array, so it
    is done inside short blocks and once over the block totals."""
    def blocks_of(a):
        starts = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int"))
        return F.transform(starts, lambda b: _running(F.slice(a, b * block + 1, block)))

    def shifted(blocks):
        return let(_running(F.transform(blocks, lambda x: F.element_at(x, -1))), lambda totals: F.flatten(F.transform(
            blocks, lambda x, b: F.transform(x, lambda v: v + F.coalesce(F.get(totals, b - 1), F.lit(0))))))

    return let(values, lambda a: F.when(F.size(a) == 0, F.array().cast("array<int>")).otherwise(
        let(blocks_of(a), shifted)))


MATCHES = "array<struct<start:int,match:string,before:string>>"


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their code-point start and the text
    between the previous match and this one. The pieces between matches give the
    offsets, so a document costs two passes of the expression."""
    def located(m):
        def with_pieces(pieces):
            ends = running_sums(F.zip_with(pieces, m, lambda p, x: F.char_length(p) + F.char_length(x)))
            return let(ends, lambda e: F.transform(m, lambda x, i: F.struct(
                (F.get(e, i) - F.char_length(x)).alias("start"), x.alias("match"), F.get(pieces, i).alias("before"))))
        return F.when(F.size(m) == 0, F.array().cast(MATCHES)).otherwise(
            let(F.slice(F.split(text, pattern, -1), 1, F.size(m)), with_pieces).cast(MATCHES))
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)
