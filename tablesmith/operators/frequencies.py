"""Long value-count table: one shuffle that serves distinct counts, top-k
categories, modes and sample values for every column at once.

Rows are ``(feature, ki, kd, ks, kh, cnt)``: the value of ``feature`` sits in
exactly one typed key column (``ki`` long for integral / boolean / date / zoned
timestamp, ``kd`` double for floating, ``ks`` string for text, zone-less timestamps in
ISO form and decimals as exact sortable digits), so values keep their native order and
distinctness. Of a text longer than ``WHOLE_TEXT`` characters ``ks`` holds the first
``WHOLE_TEXT`` and ``kh`` a 128-bit digest of all of it: a shuffled row has a bounded size
however long the texts are. Missing values are dropped. ``cnt`` is pre-aggregated
map-side, so a value holding a third of all rows is one partial count per task, not
a hot shuffle key.

``top_k`` ranks in two steps: by count and first characters, which leaves the k
best and what ties with them, then by the whole text, read again for these alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import as_double, col

KEYS = ["ki", "kd", "ks"]
WHOLE_TEXT = 64


def _keys(df: DataFrame, name: str) -> tuple[Column, Column, Column] | None:
    dt = df.schema[name].dataType
    c = col(name)
    null_l, null_d, null_s = (F.lit(None).cast("long"), F.lit(None).cast("double"),
                              F.lit(None).cast("string"))
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("long"), null_d, null_s
    if isinstance(dt, T.BooleanType):
        return c.cast("long"), null_d, null_s
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return null_l, as_double(df, name), null_s
    if isinstance(dt, T.DecimalType):
        return null_l, null_d, _decimal_key(c, dt)
    if isinstance(dt, T.DateType):
        return F.unix_date(c).cast("long"), null_d, null_s
    if isinstance(dt, T.TimestampType):
        return F.unix_micros(c), null_d, null_s
    if isinstance(dt, T.TimestampNTZType):
        # ISO text keeps order and distinctness and, unlike a cast to an instant, ignores the session zone
        return null_l, null_d, c.cast("string")
    if isinstance(dt, T.StringType):
        return null_l, null_d, c
    if isinstance(dt, T.BinaryType):
        return null_l, null_d, F.base64(c)
    return None  # nested types are not profiled


DIGITS, FLIPPED = "0123456789", "9876543210"


def _decimal_key(c: Column, dt: T.DecimalType) -> Column:
    """Exact text of a decimal that sorts as the number: sign, then all digits in fixed
    width (flipped for negative numbers). Doubles would merge values beyond 2^53."""
    digits = F.lpad(F.regexp_replace(F.abs(c).cast("string"), r"[^0-9]", ""), dt.precision + 1, "0")
    return F.when(c < 0, F.concat(F.lit("0"), F.translate(digits, DIGITS, FLIPPED))).otherwise(
        F.concat(F.lit("1"), digits))


def _decimal_text(key: Column, dt: T.DecimalType) -> Column:
    negative = F.left(key, F.lit(1)) == "0"
    digits = F.substring(key, 2, dt.precision + 1)
    digits = F.when(negative, F.translate(digits, FLIPPED, DIGITS)).otherwise(digits)
    whole = F.substring(digits, 1, dt.precision + 1 - dt.scale)
    number = F.concat(F.when(negative, F.lit("-")).otherwise(F.lit("")), whole, F.lit("."),
                      F.right(digits, F.lit(dt.scale)) if dt.scale else F.lit("0"))
    return number.cast(dt).cast("string")


def profiled_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    cols = columns if columns is not None else df.columns
    return [c for c in cols if _keys(df, c) is not None]


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.StringType, T.BinaryType))


def _digest(text: Column) -> Column:
    return F.when(F.char_length(text) > WHOLE_TEXT, F.unhex(F.md5(text)))


def value_counts(df: DataFrame, columns: list[str] | None = None, whole: bool = False) -> DataFrame:
    """``(feature, ki, kd, ks, kh, cnt)`` for every non-missing value of every column; with ``whole`` ks is the
    whole text whatever its length."""
    cols = profiled_columns(df, columns)
    if not cols:
        schema = "feature string, ki long, kd double, ks string, kh binary, cnt long"
        return df.sparkSession.createDataFrame([], schema)
    structs = []
    for c in cols:
        ki, kd, ks = _keys(df, c)
        kh = F.lit(None).cast("binary")
        if _is_text(df, c) and not whole:
            ks, kh = F.left(ks, F.lit(WHOLE_TEXT)), _digest(ks)
        structs.append(F.struct(F.lit(c).alias("feature"), ki.alias("ki"), kd.alias("kd"), ks.alias("ks"), kh.alias("kh")))
    long = df.select(F.inline(F.array(*structs)))
    long = long.where(F.coalesce(F.col("ki").isNotNull(), F.lit(False))
                      | F.col("kd").isNotNull() | F.col("ks").isNotNull())
    return long.groupBy("feature", *KEYS, "kh").agg(F.count(F.lit(1)).alias("cnt"))


def value_text(df: DataFrame, name: str) -> Column:
    """Render the typed key of ``name`` back to display text (used by samples/top-k)."""
    dt = df.schema[name].dataType
    if isinstance(dt, T.BooleanType):
        return F.when(F.col("ki") == 1, F.lit("True")).otherwise(F.lit("False"))
    if isinstance(dt, T.DateType):
        return F.date_from_unix_date(F.col("ki").cast("int")).cast("string")
    if isinstance(dt, T.TimestampType):
        return F.timestamp_micros(F.col("ki")).cast("string")
    if isinstance(dt, T.TimestampNTZType):
        return F.col("ks")
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.col("ki").cast("string")
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.col("kd").cast("string")
    if isinstance(dt, T.DecimalType):
        return _decimal_text(F.col("ks"), dt)
    return F.col("ks")


def with_display_value(df: DataFrame, vc: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``value`` (text) to a value-count table, per the column's type."""
    expr = None
    for c in columns:
        e = value_text(df, c)
        expr = F.when(F.col("feature") == c, e) if expr is None else expr.when(F.col("feature") == c, e)
    return vc.withColumn("value", expr if expr is not None else F.lit(None).cast("string"))


def distinct_counts(vc: DataFrame) -> DataFrame:
    return vc.groupBy("feature").agg(F.count(F.lit(1)).alias("distinct"))


def _with_whole_texts(df: DataFrame, vc: DataFrame, columns: list[str]) -> DataFrame:
    """``ks`` becomes the whole text where the row has only its beginning; the texts come from a second read of
    the text columns, of which only those with a digest among the rows of ``vc`` are kept."""
    texts = [c for c in columns if _is_text(df, c)]
    if not texts:
        return vc
    long = df.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("_f"), _digest(_keys(df, c)[2]).alias("_h"), _keys(df, c)[2].alias("_text")) for c in texts])))
    wanted = vc.where("kh IS NOT NULL").select(F.col("feature").alias("_f"), F.col("kh").alias("_h"))
    found = long.where("_h IS NOT NULL").join(wanted, ["_f", "_h"], "left_semi").groupBy("_f", "_h").agg(F.min("_text").alias("_text"))
    same = (F.col("feature") == F.col("_f")) & (F.col("kh") == F.col("_h"))
    return vc.join(found, same, "left").withColumn("ks", F.coalesce("_text", "ks")).drop("_f", "_h", "_text")


def top_k(df: DataFrame, vc: DataFrame, k: int, columns: list[str], by_count: bool = True) -> DataFrame:
    """Rows with ``rank`` 1..k per feature and their ``value`` as text: by count desc then value asc
    (``by_count``), or smallest values first. The rank conditions are planned as
    per-partition group limits below the shuffle."""
    order = ([F.col("cnt").desc()] if by_count else []) + [F.col(k_).asc_nulls_last() for k_ in KEYS]
    w = Window.partitionBy("feature").orderBy(*order)
    near = vc.withColumn("rank", F.rank().over(w)).where(F.col("rank") <= k).drop("rank")
    best = _with_whole_texts(df, near, columns).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return with_display_value(df, best, columns)
