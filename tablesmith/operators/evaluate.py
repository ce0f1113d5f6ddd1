"""Evaluation (E1-E13) of any (label, prediction[, score / probability]) table.

Counts come from one ``groupBy(label, prediction)``: a k x k table however
many rows are scored; every metric is arithmetic on that small table. ROC and
AUC aggregate positives / negatives per distinct score and take running sums
with the bounded ``running_totals`` (no single-task sort of all scores).
AUC is the average-rank (Mann-Whitney) form, which equals the trapezoid
area under the full ROC curve, ties included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bounded
from ..functions.stats import safe_div
from .ranking import DEFAULT_MAX_TASK_ROWS, running_totals

MAX_GRID = 1000     # classes of a confusion matrix
METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc"]


def _pairs(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("t"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def _classes(pairs: DataFrame) -> DataFrame:
    """Union of true and predicted classes (k rows)."""
    return pairs.select(F.col("t").alias("c")).union(pairs.select("p")).where(F.col("c").isNotNull()).distinct()


def per_class(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Class, precision, recall, f1, support (0 on zero division; 4 dp)."""
    pairs = _pairs(df, label, prediction)
    tp = pairs.where(F.col("t") == F.col("p")).groupBy(F.col("t").alias("c")).agg(F.sum("n").alias("tp"))
    sup = pairs.groupBy(F.col("t").alias("c")).agg(F.sum("n").alias("support"))
    pred = pairs.groupBy(F.col("p").alias("c")).agg(F.sum("n").alias("predicted"))
    t = (_classes(pairs).join(tp, "c", "left").join(sup, "c", "left").join(pred, "c", "left")
         .fillna(0, ["tp", "support", "predicted"]))
    p = F.coalesce(safe_div(F.col("tp").cast("double"), F.col("predicted")), F.lit(0.0))
    r = F.coalesce(safe_div(F.col("tp").cast("double"), F.col("support")), F.lit(0.0))
    t = t.withColumn("_p", p).withColumn("_r", r)
    f1 = F.coalesce(safe_div(2 * F.col("_p") * F.col("_r"), F.col("_p") + F.col("_r")), F.lit(0.0))
    return (t.select(F.col("c").alias("class"), F.col("_p").alias("precision"), F.col("_r").alias("recall"),
                     f1.alias("f1"), F.col("support").cast("long").alias("support"), "tp")
            .orderBy("class"))


def metrics_dict(df: DataFrame, label: str = "label", prediction: str = "prediction") -> dict:
    """E1 in one job: the (true, predicted) count table has at most k x k rows,
    so it is read back and reduced on the driver (unrounded values)."""
    return metrics_of_pairs([(r["t"], r["p"], r["n"]) for r in bounded(
        _pairs(df, label, prediction), "pairs of classes", MAX_GRID * MAX_GRID)])


def metrics_of_pairs(pairs: list[tuple]) -> dict:
    """The same from the (true, predicted, rows) counts."""
    classes = {t for t, _, _ in pairs if t is not None} | {p for _, p, _ in pairs if p is not None}
    n = sum(c for _, _, c in pairs)
    acc = prec_w = rec_w = f1_w = 0.0
    for c in classes:
        tp = sum(x for t, p, x in pairs if t == c and p == c)
        sup = sum(x for t, _, x in pairs if t == c)
        pred = sum(x for _, p, x in pairs if p == c)
        prec = tp / pred if pred else 0.0
        rec = tp / sup if sup else 0.0
        f1 = 2 * prec * rec / (prec + rec) if prec + rec else 0.0
        acc += tp
        prec_w, rec_w, f1_w = prec_w + prec * sup, rec_w + rec * sup, f1_w + f1 * sup
    if not n:
        return {"accuracy": 0.0, "precision": 0.0, "recall": 0.0, "f1": 0.0}
    return {"accuracy": acc / n, "precision": prec_w / n, "recall": rec_w / n, "f1": f1_w / n}


def weighted_f1(df: DataFrame, label: str = "label", prediction: str = "prediction") -> float:
    return metrics_dict(df, label, prediction)["f1"]


def metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", digits: int = 4) -> DataFrame:
    """Accuracy and support-weighted precision / recall / F1 (4 dp)."""
    pc = per_class(df, label, prediction)
    n = F.sum("support")
    out = pc.agg(
        safe_div(F.sum("tp").cast("double"), n).alias("accuracy"),
        safe_div(F.sum(F.col("precision") * F.col("support")), n).alias("precision"),
        safe_div(F.sum(F.col("recall") * F.col("support")), n).alias("recall"),
        safe_div(F.sum(F.col("f1") * F.col("support")), n).alias("f1"))
    return out.select(*[F.round(F.coalesce(c, F.lit(0.0)), digits).alias(c) for c in out.columns])


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Every (true, predicted) pair over the class union, with zero counts,
    and the row-normalised share."""
    pairs = _pairs(df, label, prediction).where(F.col("t").isNotNull() & F.col("p").isNotNull())
    # the class union has k rows (one per class), so the k x k grid is built from it directly
    classes = sorted(r[0] for r in bounded(_classes(pairs), "classes", MAX_GRID))
    dtype = pairs.schema["t"].dataType
    grid = df.sparkSession.createDataFrame([(a, b) for a in classes for b in classes],
                                           f"t {dtype.simpleString()}, p {dtype.simpleString()}")
    m = grid.join(pairs, ["t", "p"], "left").fillna(0, ["n"])
    row_total = F.sum("n").over(Window.partitionBy("t"))  # k rows per class
    return (m.select(F.col("t").alias("true_class"), F.col("p").alias("predicted_class"),
                     F.col("n").cast("long").alias("count"),
                     F.round(F.coalesce(safe_div(F.col("n").cast("double"), row_total), F.lit(0.0)), 4)
                     .alias("row_share"))
            .orderBy("true_class", "predicted_class"))


def report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per-class rows plus accuracy, macro avg and weighted avg rows."""
    pc = per_class(df, label, prediction).cache()
    n = pc.agg(F.sum("support")).first()[0] or 0
    body = pc.select(F.col("class").cast("string").alias("row"), F.lit(0).alias("ord"), "precision", "recall", "f1",
                     "support")
    acc = pc.agg(F.lit("accuracy").alias("row"), F.lit(1).alias("ord"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"),
                 safe_div(F.sum("tp").cast("double"), F.sum("support")).alias("f1"),
                 F.sum("support").cast("long").alias("support"))
    macro = pc.agg(F.lit("macro avg").alias("row"), F.lit(2).alias("ord"), F.avg("precision").alias("precision"),
                   F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
                   F.sum("support").cast("long").alias("support"))
    w = lambda c: safe_div(F.sum(F.col(c) * F.col("support")), F.lit(n))
    weighted = pc.agg(F.lit("weighted avg").alias("row"), F.lit(3).alias("ord"), w("precision").alias("precision"),
                      w("recall").alias("recall"), w("f1").alias("f1"), F.sum("support").cast("long").alias("support"))
    out = body.unionByName(acc).unionByName(macro).unionByName(weighted)
    return out.select("row", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")], "support", "ord") \
        .orderBy("ord", "row").drop("ord")


# --------------------------------------------------------------------- E5-E7
def _score_counts(df: DataFrame, positive, label: str, score: str, group: str | None = None) -> DataFrame:
    g = [F.col(group).alias("g")] if group else [F.lit(0).alias("g")]
    is_pos = (F.col(label) == F.lit(positive)) if positive is not None else (F.col(label) == F.col(group))
    return (df.where(F.col(score).isNotNull())
            .groupBy(*g, F.col(score).cast("double").alias("s"))
            .agg(F.count(F.when(is_pos, 1)).alias("pos"), F.count(F.when(~is_pos, 1)).alias("neg")))


def _auc_from_counts(counts: DataFrame, max_task_rows: int) -> DataFrame:
    c = counts.withColumn("n", F.col("pos") + F.col("neg"))
    cum = running_totals(c, ["g"], ["s"], ["n"], max_task_rows)
    ranked = cum.withColumn("avg_rank", F.col("n_cum") - F.col("n") + (F.col("n") + 1) / 2.0)
    s = ranked.groupBy("g").agg(F.sum(F.col("pos") * F.col("avg_rank")).alias("rs"), F.sum("pos").alias("P"),
                                F.sum("neg").alias("N"))
    auc = safe_div(F.col("rs") - F.col("P") * (F.col("P") + 1) / 2.0, (F.col("P") * F.col("N")).cast("double"))
    return s.select("g", auc.alias("roc_auc"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", positive=1,
            max_task_rows: int = DEFAULT_MAX_TASK_ROWS) -> DataFrame:
    """E5: binary ROC-AUC (positive class given); null unless both classes occur."""
    auc = _auc_from_counts(_score_counts(df, positive, label, score), max_task_rows)
    return auc.select(F.round("roc_auc", 4).alias("roc_auc"))


def _curve_from_counts(counts: DataFrame, max_task_rows: int) -> DataFrame:
    """(g, threshold, fpr, tpr) per group and distinct score, plus (inf, 0, 0)."""
    cum = running_totals(counts.withColumn("ns", -F.col("s")), ["g"], ["ns"], ["pos", "neg"], max_task_rows)
    tot = counts.groupBy("g").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))  # one row per group
    pts = cum.join(F.broadcast(tot), "g").select(
        "g", F.col("s").alias("threshold"),
        F.coalesce(safe_div(F.col("neg_cum").cast("double"), F.col("N")), F.lit(0.0)).alias("fpr"),
        F.coalesce(safe_div(F.col("pos_cum").cast("double"), F.col("P")), F.lit(0.0)).alias("tpr"))
    start = tot.select("g", F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(start).select("g", "threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


def roc_curve(df: DataFrame, label: str = "label", score: str = "score", positive=1,
              max_task_rows: int = DEFAULT_MAX_TASK_ROWS, group: str | None = None) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score, highest threshold first,
    plus the (inf, 0, 0) start point. Collinear points are kept."""
    out = _curve_from_counts(_score_counts(df, positive, label, score, group), max_task_rows)
    return (out.withColumnRenamed("g", group) if group else out.drop("g")).orderBy(F.desc("threshold"))


def _one_vs_rest(df: DataFrame, label: str, probability: str) -> DataFrame:
    """Positives and negatives per class index and distinct probability of that class."""
    from pyspark.ml.functions import vector_to_array
    p = F.col(probability)
    if df.schema[probability].dataType.typeName() == "vector":
        p = vector_to_array(probability)
    long = df.select(F.col(label).cast("double").alias("_y"), F.posexplode(p).alias("cls", "_s"))
    return (long.groupBy(F.col("cls").alias("g"), F.col("_s").cast("double").alias("s"))
            .agg(F.count(F.when(F.col("_y") == F.col("cls"), 1)).alias("pos"),
                 F.count(F.when(F.col("_y") != F.col("cls"), 1)).alias("neg")))


def multiclass_roc_auc(df: DataFrame, label: str = "label", probability: str = "probability",
                       max_task_rows: int = DEFAULT_MAX_TASK_ROWS) -> DataFrame:
    """One-vs-rest AUC per class index from a probability array / vector."""
    auc = _auc_from_counts(_one_vs_rest(df, label, probability), max_task_rows)
    return auc.select(F.col("g").cast("int").alias("class_index"), F.round("roc_auc", 4).alias("roc_auc")) \
        .orderBy("class_index")


def multiclass_roc_curve(df: DataFrame, label: str = "label", probability: str = "probability",
                         max_task_rows: int = DEFAULT_MAX_TASK_ROWS) -> DataFrame:
    """The one-vs-rest curve points per class index, highest threshold first."""
    out = _curve_from_counts(_one_vs_rest(df, label, probability), max_task_rows)
    return out.withColumn("class_index", F.col("g").cast("int")).select(
        "class_index", "threshold", "fpr", "tpr").orderBy("class_index", F.desc("threshold"))


# --------------------------------------------------------------------- E8-E13
def evaluate_all(scored: dict[str, DataFrame], label: str = "label", prediction: str = "prediction",
                 score: str | None = None, positive=1, times: dict[str, float] | None = None) -> DataFrame:
    """One metrics row per model; a model whose evaluation fails has null
    metrics and the reason in ``error``."""
    rows = []
    spark = None
    for i, (name, df) in enumerate(scored.items()):
        spark = df.sparkSession
        try:
            m = metrics_dict(df, label, prediction)
            auc = roc_auc(df, label, score, positive).first()[0] if score and score in df.columns else None
            rows.append((name, i, *[m[k] for k in METRICS[:4]], auc,
                         float((times or {}).get(name, 0.0)), None))
        except Exception as e:  # noqa: BLE001 - one failing model must not hide the others
            rows.append((name, i, None, None, None, None, None, float((times or {}).get(name, 0.0)),
                         f"{type(e).__name__}: {e}"[:500]))
    if spark is None:
        return None
    # one row per model; rounded by Spark like every other metric table
    out = spark.createDataFrame(rows, COMPARISON_SCHEMA)
    return out.select("model", "model_ord", *[F.round(k, 4).alias(k) for k in METRICS[:4]], "roc_auc",
                      "training_time", "error")


COMPARISON_SCHEMA = ("model string, model_ord int, accuracy double, precision double, recall double, f1 double, "
                     "roc_auc double, training_time double, error string")


def comparison(evaluated: DataFrame) -> DataFrame:
    """Sorted by F1 desc (then model order)."""
    return _evaluated(evaluated).orderBy(F.desc("f1"), "model_ord")


def _evaluated(rows: DataFrame) -> DataFrame:
    """Without the models whose evaluation failed."""
    return rows.where(F.col("error").isNull()).drop("error") if "error" in rows.columns else rows


def best_model(evaluated: DataFrame, metric: str = "f1") -> DataFrame:
    """Best by a metric (unknown -> f1; null AUC counts as 0; first wins ties)."""
    key = metric if metric in METRICS else "f1"
    return _evaluated(evaluated).orderBy(F.desc(F.coalesce(F.col(key), F.lit(0.0))), "model_ord").limit(1)


def display_metrics(evaluated: DataFrame) -> DataFrame:
    """Metrics as text: percentages with 2 decimals, AUC 4 decimals, seconds."""
    pct = lambda c: F.format_string("%.2f%%", F.col(c) * 100)
    return _evaluated(evaluated).select("model", pct("accuracy").alias("accuracy"), pct("precision").alias("precision"),
                            pct("recall").alias("recall"), pct("f1").alias("f1"),
                            F.when(F.col("roc_auc").isNotNull(), F.format_string("%.4f", "roc_auc")).alias("roc_auc"),
                            F.format_string("%.2fs", "training_time").alias("training_time"))


def highlight(evaluated: DataFrame) -> DataFrame:
    """Per metric, is this model the max / the min; plus the total training time."""
    w = Window.partitionBy()  # one row per model: bounded
    cols = ["model"]
    for m in METRICS:
        cols += [(F.col(m) == F.max(m).over(w)).alias(f"{m}_is_max"), (F.col(m) == F.min(m).over(w)).alias(f"{m}_is_min")]
    cols.append(F.sum("training_time").over(w).alias("total_training_time"))
    return _evaluated(evaluated).select(*cols)


def metrics_long(evaluated: DataFrame) -> DataFrame:
    """(model, metric, value) for grouped charts."""
    return _evaluated(evaluated).unpivot(["model"], ["accuracy", "precision", "recall", "f1"], "metric", "value")
