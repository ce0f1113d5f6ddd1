"""M4: Gaussian naive Bayes with variance smoothing, as a Spark ML Estimator.

Fit is one grouped ``Summarizer`` pass (per-class count, mean and variance of
the feature vector, bounded buffers) plus one global variance for the
smoothing term eps = var_smoothing * max feature variance. Prediction is a
JVM expression over the feature array: per class the log prior minus the
Gaussian log density terms, then a softmax for probabilities.
"""

from __future__ import annotations

import json
import math

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _NBParams(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol):
    varSmoothing = Param(Params._dummy(), "varSmoothing", "share of the largest feature variance added to all",
                         typeConverter=TypeConverters.toFloat)


class GaussianNB(Estimator, _NBParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction",
                 probabilityCol="probability", varSmoothing=1e-9):
        super().__init__()
        self._setDefault(varSmoothing=1e-9, featuresCol="features", labelCol="label", predictionCol="prediction",
                         probabilityCol="probability")
        self._set(**self._input_kwargs)

    def setVarSmoothing(self, v):
        return self._set(varSmoothing=v)

    def _fit(self, df: DataFrame) -> "GaussianNBModel":
        fc, lc = self.getFeaturesCol(), self.getLabelCol()
        stats = Summarizer.metrics("count", "mean", "variance")
        per = (df.groupBy(F.col(lc).cast("double").alias("y"))
               .agg(stats.summary(F.col(fc)).alias("s")).orderBy("y").collect())  # one row per class
        glob = df.agg(Summarizer.metrics("count", "variance").summary(F.col(fc)).alias("s")).first()["s"]
        n = glob["count"]
        # Summarizer variance is the sample variance; the model uses the population one
        gvar = [v * (n - 1) / n for v in glob["variance"].toArray()] if n > 1 else [0.0] * len(glob["variance"])
        eps = self.getOrDefault(self.varSmoothing) * max(gvar) if gvar else 0.0
        classes = []
        for r in per:
            cnt = r["s"]["count"]
            var = [v * (cnt - 1) / cnt if cnt > 1 else 0.0 for v in r["s"]["variance"].toArray()]
            classes.append({"y": r["y"], "prior": cnt / n, "mean": list(r["s"]["mean"].toArray()),
                            "var": [v + eps for v in var]})
        m = GaussianNBModel(fitted=json.dumps(classes))
        return self._copyValues(m)


class GaussianNBModel(Model, _NBParams, DefaultParamsReadable, DefaultParamsWritable):
    fitted = Param(Params._dummy(), "fitted", "per-class prior, means and variances (JSON)",
                   typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, featuresCol="features", labelCol="label", predictionCol="prediction",
                 probabilityCol="probability", varSmoothing=1e-9, fitted=None):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction",
                         probabilityCol="probability", varSmoothing=1e-9)
        self._set(**self._input_kwargs)

    @property
    def classes(self) -> list[dict]:
        return json.loads(self.getOrDefault(self.fitted))

    def _transform(self, df: DataFrame) -> DataFrame:
        cls = self.classes
        x = vector_to_array(F.col(self.getFeaturesCol()))
        jll = []
        for c in cls:
            const = math.log(c["prior"]) - 0.5 * sum(math.log(2 * math.pi * v) for v in c["var"])
            terms = F.arrays_zip(x.alias("x"), F.array(*[F.lit(m) for m in c["mean"]]).alias("m"),
                                 F.array(*[F.lit(v) for v in c["var"]]).alias("v"))
            quad = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + (t["x"] - t["m"]) * (t["x"] - t["m"]) / t["v"])
            jll.append(F.lit(const) - 0.5 * quad)
        df = df.withColumn("_jll", F.array(*jll))
        arr = F.col("_jll")
        top = F.array_max(arr)
        probs = F.transform(arr, lambda j: F.exp(j - top))
        total = F.aggregate(probs, F.lit(0.0), lambda a, b: a + b)
        labels = F.array(*[F.lit(c["y"]) for c in cls])
        best = F.array_position(arr, top)  # first maximum: the smaller class wins a tie
        return (df.withColumn(self.getProbabilityCol(),
                            array_to_vector(F.transform(probs, lambda p: p / total)))
                .withColumn(self.getPredictionCol(), F.element_at(labels, best.cast("int")))
                .drop("_jll"))
