"""Validation predicates (V1-V9). Checks on data return a one-row DataFrame
``(check, ok, message)`` built by one aggregate; checks on arguments or the
schema return the same shape from literals. ``as_tuple`` gives (ok, message).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_missing, col

SCHEMA = "check string, ok boolean, message string"


def _lit_result(spark, check: str, ok: bool, message: str = "") -> DataFrame:
    return spark.createDataFrame([(check, ok, message)], SCHEMA)


def as_tuple(result: DataFrame) -> tuple[bool, str]:
    r = result.first()
    return bool(r["ok"]), r["message"] or ""


def _first_failure(check: str, conds: list[tuple[Column, Column]]) -> list[Column]:
    """conds: (failed?, message) in priority order."""
    msg = None
    for failed, text in reversed(conds):
        msg = F.when(failed, text) if msg is None else F.when(failed, text).otherwise(msg)
    ok = ~F.coalesce(*[F.when(f, F.lit(True)) for f, _ in conds], F.lit(False)) if conds else F.lit(True)
    return [F.lit(check).alias("check"), ok.alias("ok"), F.coalesce(msg, F.lit("")).alias("message")]


def table_ready(df: DataFrame | None, spark=None) -> DataFrame:
    """V1: table exists, has columns and rows."""
    if df is None:
        return _lit_result(spark, "table", False, "no table loaded")
    if not df.columns:
        return _lit_result(df.sparkSession, "table", False, "the table has no columns")
    n = F.count(F.lit(1))
    return df.agg(*_first_failure("table", [(n == 0, F.lit("the table has no rows"))]))


def target_ready(df: DataFrame, target: str | None) -> DataFrame:
    """V2: target chosen, present, without missing values, with >= 2 classes."""
    spark = df.sparkSession
    if not target:
        return _lit_result(spark, "target", False, "no target column chosen")
    if target not in df.columns:
        return _lit_result(spark, "target", False, f"target column '{target}' not found")
    miss = F.sum(is_missing(df, target).cast("long"))
    k = F.countDistinct(col(target))
    return df.agg(*_first_failure("target", [
        (miss > 0, F.format_string("target '%s' has %d missing values", F.lit(target), miss)),
        (k < 2, F.format_string("target '%s' has only %d distinct value(s); at least 2 classes are needed",
                                F.lit(target), k))]))


def features_ready(df: DataFrame, features: list[str], target: str | None) -> DataFrame:
    """V3: features non-empty, exclude the target, all present (schema only)."""
    spark = df.sparkSession
    if not features:
        return _lit_result(spark, "features", False, "no feature columns chosen")
    if target and target in features:
        return _lit_result(spark, "features", False, f"target '{target}' is among the features")
    missing = [c for c in features if c not in df.columns]
    if missing:
        return _lit_result(spark, "features", False, f"feature columns not found: {missing}")
    return _lit_result(spark, "features", True)


def split_ratio_ok(spark, train_ratio: float | None = None, test_size: float | None = None) -> DataFrame:
    """V4: train ratio in [0.6, 0.9] or test size in [0.1, 0.4]."""
    if train_ratio is not None and not 0.6 <= train_ratio <= 0.9:
        return _lit_result(spark, "split", False, f"train ratio {train_ratio:.0%} is outside 60%-90%")
    if test_size is not None and not 0.1 <= test_size <= 0.4:
        return _lit_result(spark, "split", False, f"test size {test_size} is outside 0.1-0.4")
    return _lit_result(spark, "split", True)


def stratify_ok(df: DataFrame, target: str, test_size: float) -> DataFrame:
    """V5: the smallest class has at least int(1 / test_size) + 1 rows."""
    need = int(1 / test_size) + 1
    counts = df.groupBy(col(target)).agg(F.count(F.lit(1)).alias("n"))
    low = F.min("n")
    return counts.agg(*_first_failure("stratify", [
        (low < need, F.format_string("smallest class has %d rows; a stratified split needs %d", low, F.lit(need)))]))


def content_ok(df: DataFrame, min_rows: int = 10, min_columns: int = 2) -> DataFrame:
    """V6: unique column names, at least 10 rows and 2 columns."""
    spark = df.sparkSession
    seen, dups = set(), []
    for c in df.columns:
        if c in seen and c not in dups:
            dups.append(c)
        seen.add(c)
    if dups:
        return _lit_result(spark, "content", False, f"duplicate column names: {dups}")
    if len(df.columns) < min_columns:
        return _lit_result(spark, "content", False, f"only {len(df.columns)} column(s); need {min_columns}")
    n = F.count(F.lit(1))
    return df.agg(*_first_failure("content", [
        (n < min_rows, F.format_string("only %d rows; need at least %d", n, F.lit(min_rows)))]))


def numeric_in_range(df: DataFrame, column: str, min_val: float | None = None,
                     max_val: float | None = None) -> DataFrame:
    """V7 (column form): rows whose value does not parse as a number or lies
    outside [min, max], with the reason."""
    v = col(column).cast("string").try_cast("double")
    reason = F.when(v.isNull(), F.lit("not a number"))
    if min_val is not None:
        reason = reason.when(v < F.lit(min_val), F.format_string("below minimum %s", F.lit(str(min_val))))
    if max_val is not None:
        reason = reason.when(v > F.lit(max_val), F.format_string("above maximum %s", F.lit(str(max_val))))
    return df.withColumn("reason", reason).where(F.col("reason").isNotNull())


def prediction_rows_ok(df: DataFrame, features: list[str]) -> DataFrame:
    """V8: every feature present (else an error), and rows where any feature is
    null or empty text, with the offending columns listed."""
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"missing required features: {missing}")
    bad = F.array_compact(F.array(*[
        F.when(col(c).isNull() | (F.trim(col(c).cast("string")) == ""), F.lit(c)) for c in features]))
    return df.withColumn("empty_features", bad).where(F.size("empty_features") > 0)


def split_ready(train: DataFrame, test: DataFrame, label: str = "label") -> DataFrame:
    """V9: train and test not empty and train has at least two classes."""
    t = train.agg(F.count(F.lit(1)).alias("n_train"), F.countDistinct(label).alias("k"))
    s = test.agg(F.count(F.lit(1)).alias("n_test"))
    r = t.first(), s.first()
    spark = train.sparkSession
    if r[0]["n_train"] == 0:
        return _lit_result(spark, "split", False, "training set is empty")
    if r[1]["n_test"] == 0:
        return _lit_result(spark, "split", False, "test set is empty")
    if r[0]["k"] < 2:
        return _lit_result(spark, "split", False, "training set has fewer than 2 classes")
    return _lit_result(spark, "split", True)
