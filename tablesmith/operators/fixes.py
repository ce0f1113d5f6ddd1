"""Data-quality fixes.

Each fix is a lazy column / filter node; only its statistic (mean, exact
median, mode, exact quartiles) is an action, and that statistic is computed
on the frame as already fixed by the earlier steps of a plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import as_double, is_missing, is_numeric, col
from .profile import iqr_bounds
from .quantiles import exact_quantiles

MISSING_METHODS = ("mean", "median", "mode", "drop_rows", "drop_column", "keep")
OUTLIER_METHODS = ("remove", "cap", "keep")


def _require_numeric(df: DataFrame, column: str, method: str) -> None:
    if not is_numeric(df.schema[column].dataType):
        raise ValueError(f"'{method}' needs a numeric column; '{column}' is "
                         f"{df.schema[column].dataType.simpleString()}")


def _fill(df: DataFrame, column: str, value) -> DataFrame:
    if value is None:
        return df
    dt = df.schema[column].dataType
    filled = F.when(is_missing(df, column), F.lit(value).cast(dt)).otherwise(col(column))
    return df.withColumn(column, filled)


def fill_mean(df: DataFrame, column: str) -> DataFrame:
    """missing values take the column mean (a whole-column statistic)."""
    _require_numeric(df, column, "mean")
    mean = df.agg(F.avg(as_double(df, column))).first()[0]
    if mean is not None and not isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)):
        df = df.withColumn(column, col(column).cast("double"))
    return _fill(df, column, mean)


def fill_median(df: DataFrame, column: str, **qkw) -> DataFrame:
    """missing values take the exact median (linear interpolation)."""
    _require_numeric(df, column, "median")
    med = exact_quantiles(df, [column], [0.5], **qkw)[column][0]
    if med is not None and not isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)):
        df = df.withColumn(column, col(column).cast("double"))
    return _fill(df, column, med)


def mode_value(df: DataFrame, column: str):
    """Most frequent non-missing value; the smallest one wins a tie. Planned as
    a partial count per task plus a top-1 (TakeOrderedAndProject)."""
    counts = (df.where(~is_missing(df, column)).groupBy(column).agg(F.count(F.lit(1)).alias("_n")))
    row = counts.orderBy(F.desc("_n"), F.asc(column)).first()
    return None if row is None else row[column]


def fill_mode(df: DataFrame, column: str) -> DataFrame:
    """missing values take the mode (works for text and numbers)."""
    return _fill(df, column, mode_value(df, column))


def drop_missing_rows(df: DataFrame, column: str) -> DataFrame:
    """drop rows where the column is missing."""
    return df.where(~is_missing(df, column))


def drop_column(df: DataFrame, column: str) -> DataFrame:
    """F5."""
    return df.drop(column)


def outlier_bounds(df: DataFrame, column: str, **qkw) -> tuple[float, float] | None:
    q = exact_quantiles(df, [column], [0.25, 0.75], **qkw)[column]
    if q[0] is None:
        return None
    _, _, lo, hi = iqr_bounds({column: q})[column]
    return lo, hi


def remove_outliers(df: DataFrame, column: str, **qkw) -> DataFrame:
    """keep rows with lower <= x <= upper (1.5 IQR fences); missing values
    go too, as in a comparison with NaN."""
    _require_numeric(df, column, "remove")
    b = outlier_bounds(df, column, **qkw)
    if b is None:
        return df.where(F.lit(False))
    v = as_double(df, column)
    return df.where((v >= F.lit(b[0])) & (v <= F.lit(b[1])))


def cap_outliers(df: DataFrame, column: str, **qkw) -> DataFrame:
    """winsorise to the fences; missing values stay missing. The result is
    double, like a clip with fractional bounds."""
    _require_numeric(df, column, "cap")
    b = outlier_bounds(df, column, **qkw)
    if b is None:
        return df
    v = as_double(df, column)
    return df.withColumn(column, F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(b[0])), F.lit(b[1]))))


def keep(df: DataFrame, column: str) -> DataFrame:
    """F8: no-op."""
    return df


_STEP = {("missing", "mean"): fill_mean, ("missing", "median"): fill_median, ("missing", "mode"): fill_mode,
         ("missing", "drop_rows"): drop_missing_rows, ("missing", "drop_column"): drop_column,
         ("missing", "keep"): keep, ("outlier", "remove"): remove_outliers, ("outlier", "cap"): cap_outliers,
         ("outlier", "keep"): keep}

_TEXT = {"mean": "filled missing {c} with the mean", "median": "filled missing {c} with the median",
         "mode": "filled missing {c} with the mode", "drop_rows": "dropped rows with missing {c}",
         "drop_column": "dropped column {c}", "keep": "kept {c} as is",
         "remove": "removed outlier rows of {c}", "cap": "capped outliers of {c}"}


@dataclass
class FixResult:
    table: DataFrame
    log: DataFrame          # (ord, column, issue, method, text)
    rows: int
    columns: int


def apply_plan(df: DataFrame, plan: list[tuple[str, str, str]], count: bool = True) -> FixResult:
    """apply ``(issue, column, method)`` steps in order (issue is 'missing'
    or 'outlier'). Each statistic is taken on the frame fixed so far. A step on
    a column that an earlier step dropped is skipped and logged."""
    log = []
    cur = df
    for i, (issue, column, method) in enumerate(plan):
        fn = _STEP.get((issue, method))
        if fn is None:
            raise ValueError(f"unknown fix {issue}/{method}")
        if column not in cur.columns:
            log.append((i, column, issue, method, f"skipped: column {column} is not in the table"))
            continue
        cur = fn(cur, column)
        log.append((i, column, issue, method, _TEXT[method].format(c=column)))
    spark = df.sparkSession
    log_df = spark.createDataFrame(log, "ord int, column string, issue string, method string, text string")
    return FixResult(cur, log_df, cur.count() if count else -1, len(cur.columns))
