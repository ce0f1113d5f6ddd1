"""Save / load a model bundle: the fitted preparation (a PipelineModel),
the trained model, and a metadata.json with the label classes, feature
names, configuration, metrics, parameters and training time.

Spark ML models save with their own writers; the k-NN model saves its
training table as Parquet plus its parameters.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_json_string

from ..operators.models.catalogue import Trained
from ..operators.models.knn import KNNModel
from ..operators.models.naive_bayes import GaussianNBModel
from ..operators.prepare import LabelMap, PrepConfig, Prepared


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path).collect())


def save_bundle(path: str, prep: Prepared, trained: Trained, metrics: dict | None = None) -> None:
    spark = prep.train.sparkSession
    prep.model.write().overwrite().save(f"{path}/preparation")
    m = trained.model
    if isinstance(m, KNNModel):
        m.train.write.mode("overwrite").parquet(f"{path}/model/train")
        kind = "knn"
        params = {p.name: m.getOrDefault(p) for p in m.params if m.hasDefault(p) or m.isSet(p)}
    else:
        m.write().overwrite().save(f"{path}/model")
        kind = type(m).__module__ + "." + type(m).__name__
        params = {}
    meta = {"model_name": trained.name, "model_kind": kind, "knn_params": params,
            "classes": [str(c) for c in prep.labels.classes], "class_type": prep.labels.dtype.json(),
            "feature_names": prep.feature_names, "numeric": prep.numeric, "categorical": prep.categorical,
            "config": asdict(prep.config), "metrics": metrics or {}, "params": trained.params,
            "training_time": trained.seconds}
    _write_text(spark, f"{path}/metadata.json", json.dumps(meta, default=str))


def load_bundle(spark: SparkSession, path: str) -> tuple[Prepared, Trained, dict]:
    meta = json.loads(_read_text(spark, f"{path}/metadata.json"))
    prep_model = PipelineModel.load(f"{path}/preparation")
    dtype = _parse_datatype_json_string(meta["class_type"])
    classes = spark.createDataFrame([(c,) for c in meta["classes"]], "c string").select(F.col("c").cast(dtype)).collect()
    labels = LabelMap([r[0] for r in classes], dtype)
    cfg = meta["config"]
    cfg = PrepConfig(**{**cfg, "features": tuple(cfg["features"]), "key": tuple(cfg["key"]) if cfg["key"] else None})
    prep = Prepared(None, None, prep_model, labels, meta["feature_names"], meta["numeric"], meta["categorical"], cfg)
    kind = meta["model_kind"]
    if kind == "knn":
        model = KNNModel(spark.read.parquet(f"{path}/model/train"), [float(i) for i in range(len(classes))])
        for k, v in meta["knn_params"].items():
            if model.hasParam(k):
                model._set(**{k: v})
    elif kind.endswith("GaussianNBModel"):
        model = GaussianNBModel.load(f"{path}/model")
    else:
        mod, cls = kind.rsplit(".", 1)
        model = getattr(__import__(mod, fromlist=[cls]), cls).load(f"{path}/model")
    trained = Trained(meta["model_name"], model, meta["training_time"], meta["params"])
    return prep, trained, meta
