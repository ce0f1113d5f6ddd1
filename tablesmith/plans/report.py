"""The run report as one long table (section, ord, key, value), and its
Markdown rendering written as a single text file.

Every section is built from the small result tables (profile, issues,
preparation settings, model comparison), so the report is bounded by the
number of columns, issues and models, never by rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "section string, ord int, key string, value string"
SECTIONS = ["Table", "Profile", "Quality", "Preparation", "Models", "Scores", "Choice", "Run"]


def overview_section(spark: SparkSession, rows: int, columns: int, target: str | None, classes: list,
                     source: str = "") -> DataFrame:
    facts = {"rows": rows, "columns": columns, "target": target, "source": source}
    facts |= {f"class {i}": c for i, c in enumerate(classes)}
    return spark.createDataFrame([(SECTIONS[0], i, k, str(v)) for i, (k, v) in enumerate(
        (k, v) for k, v in facts.items() if v not in (None, ""))], SCHEMA)


def eda_section(missing: DataFrame, outliers_iqr: DataFrame, high_pairs: DataFrame) -> DataFrame:
    """Missing cells in total, columns with at least one outlier, correlated pairs."""
    counts = [("missing cells", missing.agg(F.coalesce(F.sum("missing_count"), F.lit(0)).alias("v"))),
              ("columns with outliers", outliers_iqr.agg(F.count(F.when(F.col("total_outliers") > 0, 1)).alias("v"))),
              ("correlated column pairs", high_pairs.agg(F.count(F.lit(1)).alias("v")))]
    parts = [c.select(F.lit(SECTIONS[1]).alias("section"), F.lit(i).alias("ord"), F.lit(k).alias("key"),
                      F.col("v").cast("string").alias("value")) for i, (k, c) in enumerate(counts)]
    return parts[0].union(parts[1]).union(parts[2])


def issues_section(issues: DataFrame) -> DataFrame:
    return issues.select(
        F.lit(SECTIONS[2]).alias("section"),
        F.row_number().over(Window.orderBy(  # issues: columns x rules rows
            F.array_position(F.array(*[F.lit(s) for s in ["Critical", "High", "Medium", "Low"]]), F.col("severity")),
            "rule_ord", "col_ord")).cast("int").alias("ord"),
        F.concat_ws(" | ", "issue_type", F.array_join("affected_columns", ", "), "severity").alias("key"),
        F.col("description").alias("value"))


def settings_section(settings: DataFrame) -> DataFrame:
    return settings.select(F.lit(SECTIONS[3]).alias("section"), F.col("ord").cast("int"),
                           F.col("setting").alias("key"), "value")


def models_section(comparison: DataFrame) -> DataFrame:
    n = comparison.agg(F.count(F.lit(1)).alias("n"))
    cfg = n.select(F.lit(SECTIONS[4]).alias("section"), F.lit(0).alias("ord"), F.lit("trained").alias("key"),
                   F.col("n").cast("string").alias("value"))
    rows = comparison.select(
        F.lit(SECTIONS[5]).alias("section"), F.col("model_ord").cast("int").alias("ord"), F.col("model").alias("key"),
        F.format_string("f1 %.4f, accuracy %.4f, precision %.4f, recall %.4f, fitted in %.2f s", "f1", "accuracy",
                        "precision", "recall", "training_time").alias("value"))
    return cfg.unionByName(rows)


def best_section(spark: SparkSession, best: dict, params: dict, run: dict) -> DataFrame:
    """The chosen model with its scores and settings, and the settings of the run (``run``: name -> value)."""
    choice = [("model", str(best["model"]))] + [(k, f"{best[k]:.4f}") for k in (
        "f1", "accuracy", "precision", "recall", "roc_auc") if best.get(k) is not None] if best else []
    choice += [(f"setting {k}", str(v)) for k, v in params.items()]
    rows = [(SECTIONS[6], i, k, v) for i, (k, v) in enumerate(choice)]
    rows += [(SECTIONS[7], i, k, str(v)) for i, (k, v) in enumerate(run.items())]
    return spark.createDataFrame(rows, SCHEMA)


def assemble(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    sec = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section"))
    return out.withColumn("section_ord", sec.cast("int")).orderBy("section_ord", "ord")


def to_markdown(report: DataFrame, title: str = "Classification report") -> DataFrame:
    """One text row: the report as Markdown, sections in their fixed order
    (the report table is small: sections x items)."""
    lines = report.select(F.struct("section_ord", "ord", "section", "key", "value").alias("r")) \
        .agg(F.array_sort(F.collect_list("r")).alias("rs"))
    text = F.aggregate(
        "rs", F.struct(F.lit(f"# {title}\n").alias("t"), F.lit("").alias("s")),
        lambda acc, x: F.struct(
            F.concat(acc["t"], F.when(x["section"] != acc["s"], F.concat(F.lit("\n## "), x["section"], F.lit("\n\n")))
                     .otherwise(F.lit("")), F.lit("- **"), x["key"], F.lit(":** "), x["value"], F.lit("\n")).alias("t"),
            x["section"].alias("s")),
        lambda acc: acc["t"])
    return lines.select(text.alias("value"))


def write_markdown(report: DataFrame, path: str) -> None:
    to_markdown(report).coalesce(1).write.mode("overwrite").text(path)
