"""Scoring (I1-I4): apply the fitted preparation and a trained model to new
rows, decode the class, add confidence and per-class probabilities, and
summarise; plus the value ranges of the training features for input checks."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_double, numeric_columns
from . import frequencies as fq
from .prepare import Prepared, apply_to_new


def score(prep: Prepared, model, new_rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """I1 + I2: kept columns, ``predicted_class`` (original class values),
    ``confidence`` = max probability and ``p_<class>`` per class (when the model
    gives probabilities). Works on batch and streaming DataFrames alike for
    models whose transform is a plain projection."""
    x = apply_to_new(prep, new_rows, keep)
    out = model.transform(x)
    cols = [*(keep or []), prep.labels.decode("prediction").alias("predicted_class")]
    if "probability" in out.columns:
        p = vector_to_array("probability")
        cols.append(F.array_max(p).alias("confidence"))
        cols += [F.element_at(p, i + 1).alias(f"p_{c}") for i, c in enumerate(prep.labels.classes)]
    return out.select(*cols)


def prediction_summary(scored: DataFrame) -> DataFrame:
    """Per predicted class: count and % of rows, with the overall average,
    minimum and maximum confidence (null without probabilities)."""
    has_conf = "confidence" in scored.columns
    conf = F.col("confidence") if has_conf else F.lit(None).cast("double")
    per = scored.groupBy("predicted_class").agg(F.count(F.lit(1)).alias("count"),
                                                F.sum(conf).alias("_cs"), F.min(conf).alias("_mn"),
                                                F.max(conf).alias("_mx"))
    allw = Window.partitionBy()  # one row per class: bounded
    n = F.sum("count").over(allw)
    return per.select(F.col("predicted_class").cast("string").alias("predicted_class"),
                      F.col("count").cast("long").alias("count"),
                      F.round(F.col("count") * 100.0 / n, 2).alias("pct"),
                      F.round(F.sum("_cs").over(allw) / n, 4).alias("avg_confidence"),
                      F.round(F.min("_mn").over(allw), 4).alias("min_confidence"),
                      F.round(F.max("_mx").over(allw), 4).alias("max_confidence"))


def feature_ranges(df: DataFrame, features: list[str]) -> DataFrame:
    """I4 (numbers): min, max, mean and the input bounds min - 50 % range,
    max + 50 % range, per numeric feature (one aggregate pass)."""
    nums = [c for c in numeric_columns(df) if c in features]
    if not nums:
        return df.sparkSession.createDataFrame([], "feature string, min double, max double, mean double, "
                                                   "input_min double, input_max double")
    aggs = []
    for i, c in enumerate(nums):
        v = as_double(df, c)
        aggs += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.avg(v).alias(f"m{i}")]
    row = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"),
                     F.col(f"m{i}").alias("mean"),
                     (F.col(f"lo{i}") - 0.5 * (F.col(f"hi{i}") - F.col(f"lo{i}"))).alias("input_min"),
                     (F.col(f"hi{i}") + 0.5 * (F.col(f"hi{i}") - F.col(f"lo{i}"))).alias("input_max"))
            for i, c in enumerate(nums)]
    return row.select(F.inline(F.array(*rows)))


def feature_categories(df: DataFrame, features: list[str]) -> DataFrame:
    """I4 (text): the distinct values of each text feature as rows
    (feature, value, count); a long table, so a wide category set stays distributed."""
    cats = [f.name for f in df.schema.fields if f.name in features and f.dataType.typeName() == "string"]
    if not cats:
        return df.sparkSession.createDataFrame([], "feature string, value string, count long")
    vc = fq.value_counts(df, cats, whole=True)
    return vc.select("feature", F.col("ks").alias("value"), F.col("cnt").cast("long").alias("count"))
