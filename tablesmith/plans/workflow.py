"""The reference's end-to-end flow as one call: profile -> issues -> fixes ->
prepare/split -> train (or tune) -> evaluate -> report. Each step is the
library operator; this module only wires their outputs together."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import fixes as FX
from ..operators import prepare as T
from ..operators import quality as Q
from ..operators.correlation import high_correlation_pairs
from ..operators.models import catalogue as M
from . import report as R
from .full_profile import full_profile


@dataclass
class RunResult:
    profile: object
    issues: DataFrame
    prepared: T.Prepared
    trained: dict
    comparison: DataFrame
    report: DataFrame
    seconds: dict = field(default_factory=dict)
    errors: DataFrame | None = None     # (model, error) of models that failed to fit or to be evaluated


def run(df: DataFrame, cfg: T.PrepConfig, models: list[str] | None = None, fix_plan=None,
        tune: str | None = None, n_iter: int = 10) -> RunResult:
    secs = {}
    t = time.time()
    prof = full_profile(df)
    secs["profile"] = time.time() - t
    t = time.time()
    issues = Q.run_all(df, target=cfg.target, profile=prof).cache()
    issues.count()
    secs["issues"] = time.time() - t
    if fix_plan:
        df = FX.apply_plan(df, fix_plan, count=False).table
    t = time.time()
    prep = T.prepare(df, cfg, keep=list(cfg.key or []))
    secs["prepare"] = time.time() - t
    t = time.time()
    if tune:
        from ..operators import tuning as H
        done, failed = H.tune_all(prep.train, models, method=tune, n_iter=n_iter, key=list(cfg.key or []))
        trained = {n: r.best for n, r in done.items()}
    else:
        trained, failed = M.train_all(prep.train, models)
    secs["train"] = time.time() - t
    t = time.time()
    key = list(cfg.key or [])
    scored = {n: M.predict(tr, prep.test, key[0] if len(key) == 1 else None) for n, tr in trained.items()}
    positive = 1.0 if len(prep.labels.classes) == 2 else None
    ev = E.evaluate_all({n: (s.withColumn("score", F.element_at(vector_to_array("probability"), 2))
                             if positive is not None and "probability" in s.columns else s)
                         for n, s in scored.items()},
        score="score" if positive is not None else None, positive=positive,
        times={n: tr.seconds for n, tr in trained.items()}).cache()
    comp = E.comparison(ev)
    errors = failed.select("model", "error").union(ev.where(F.col("error").isNotNull()).select("model", "error"))
    best = E.best_model(ev).first()
    secs["evaluate"] = time.time() - t
    spark = df.sparkSession
    pairs = high_correlation_pairs(prof.correlation, 0.7)
    rep = R.assemble([
        R.overview_section(spark, prof.rows, len(df.columns), cfg.target, prep.labels.classes),
        R.eda_section(prof.missing, prof.outliers_iqr, pairs),
        R.issues_section(issues),
        R.settings_section(T.config_summary(spark, cfg)),
        R.models_section(comp),
        R.best_section(spark, best.asDict() if best else {}, trained[best["model"]].params if best else {},
                       {"ranked by": "f1", "seed": cfg.random_state, "tuning": tune or "none"})])
    return RunResult(prof, issues, prep, trained, comp, rep, secs, errors)
