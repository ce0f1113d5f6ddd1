"""Column typing (R1, R2) and small column-expression helpers.

Everything here is a schema walk or a pure Column expression: no Spark job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def field_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def is_integral(dt: T.DataType) -> bool:
    return isinstance(dt, INTEGRAL_TYPES)


def is_datetime(dt: T.DataType) -> bool:
    return isinstance(dt, DATETIME_TYPES)


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns (booleans excluded, as in profiling)."""
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def categorical_columns(df: DataFrame) -> list[str]:
    """Text columns."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def feature_column_types(df: DataFrame, features: list[str]) -> tuple[list[str], list[str]]:
    """R2: split chosen features into (numeric incl. boolean, other); unknown names skipped."""
    names = set(df.columns)
    num, cat = [], []
    for c in features:
        if c not in names:
            continue
        dt = field_type(df, c)
        if is_numeric(dt) or isinstance(dt, T.BooleanType):
            num.append(c)
        elif isinstance(dt, (T.ArrayType, T.MapType, T.StructType)):
            raise TypeError(f"column '{c}' has nested type {dt.simpleString()} and cannot be a feature")
        else:
            cat.append(c)
    return num, cat


def as_double(df: DataFrame, name: str) -> Column:
    """Numeric column as double with NaN mapped to null (pandas treats both as missing)."""
    c = col(name)
    dt = field_type(df, name)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    return c.cast("double")


def is_missing(df: DataFrame, name: str) -> Column:
    """Missing = null, or NaN for floating columns."""
    c = col(name)
    dt = field_type(df, name)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def type_name(dt: T.DataType) -> str:
    """User-facing type name; timestamps with and without zone are both 'timestamp'."""
    return "timestamp" if isinstance(dt, T.TimestampNTZType) else dt.simpleString()


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """The column of that exact name, whatever signs (dots, back-ticks) it holds."""
    return F.col(quote(name))


MAX_CLASSES = 10_000


def bounded(rows: DataFrame, what: str, limit: int = MAX_CLASSES) -> list:
    """Collect a table of one row per class (or category): an error beyond ``limit`` rows,
    instead of an unbounded list on the driver."""
    got = rows.limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError(f"more than {limit} {what}; choose another column or raise the limit")
    return got
