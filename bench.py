"""Benchmark: the reference's three published targets (EDA time, training
time, prediction latency) plus the headline operators, at $BENCH_SF_DIR on
local[$BENCH_CPUS]. Prints one JSON line.

Every timed step forces its whole result (``noop`` write or a small collect).
A warm-up on the 5-row ``region`` table runs first and is not timed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tablesmith.operators import evaluate as E  # noqa: E402
from tablesmith.operators import prepare as T  # noqa: E402
from tablesmith.operators import quality as Q  # noqa: E402
from tablesmith.operators import score as S  # noqa: E402
from tablesmith.operators.models import catalogue as M  # noqa: E402
from tablesmith.plans.full_profile import full_profile  # noqa: E402
from tablesmith.session import get_session  # noqa: E402
from tablesmith.sources.tables import read_table  # noqa: E402
from tablesmith.suite import QUERIES  # noqa: E402

HEADLINE = ["p08_outliers_iqr", "p03_summary_statistics", "p02_column_info", "p10_pearson", "p11_spearman",
            "q07_run_all", "t11_stratified_split", "e06_roc_curve", "m02_knn", "m04_naive_bayes"]


def force(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(cores=cpus, shuffle_partitions=max(8, 2 * cpus), app="tablesmith-bench")
    times: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.time()
        out = fn()
        times[name] = round(time.time() - t0, 3)
        return out

    # warm-up, not timed: JVM class loading / JIT and Python workers, on the 5-row region table
    region = read_table(spark, sf_dir, "region")
    warm = full_profile(region)
    Q.run_all(region, profile=warm).collect()
    warm.unpersist()

    ev = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts")
    li = read_table(spark, sf_dir, "lineitem")

    # EDA target (reference: <= 30 s for 100k rows): full profile + all quality rules
    def eda(df, target):
        p = full_profile(df)
        for d in (p.missing, p.outliers_iqr, p.outliers_zscore, p.correlation, p.numeric_distribution,
                  p.categorical_distribution):
            d.collect()
        Q.run_all(df, target=target, profile=p).collect()
        p.unpersist()
    timed("eda_events", lambda: eda(ev, "event_type"))
    timed("eda_lineitem", lambda: eda(li, "l_returnflag"))

    # training target (reference: <= 15 min for 50k rows): split + fit pipeline + all seven models
    wide = read_table(spark, sf_dir, "events").select(
        "event_id", "event_type", "value", "user_id", F.hour("ts").alias("hour"), F.dayofweek("ts").alias("weekday"),
        F.get_json_object("props", "$.k").cast("double").alias("k"), (F.col("user_id") % 7).cast("string").alias("region"))
    cfg = T.PrepConfig(target="event_type", features=("value", "user_id", "hour", "weekday", "k", "region"),
                       key=("event_id",))
    prep = timed("prepare_events", lambda: T.prepare(wide, cfg, keep=["event_id"]))
    trained = timed("train_all_events", lambda: M.train_all(prep.train)[0])
    for name, tr in trained.items():
        times[f"fit[{name}]"] = round(tr.seconds, 3)

    def evaluate():
        scored = {n: M.predict(t, prep.test, "event_id") for n, t in trained.items()}
        return E.comparison(E.evaluate_all(scored, times={n: t.seconds for n, t in trained.items()})).collect()
    timed("evaluate_events", evaluate)

    # prediction latency target (reference: <= 2 s per response): one new row, and a full batch
    nb = trained["Naive Bayes"]
    one = wide.limit(1).cache()
    one.count()
    timed("predict_one_row", lambda: S.score(prep, nb.model, one, keep=["event_id"]).collect())
    timed("score_batch_events", lambda: force(S.score(prep, nb.model, wide, keep=["event_id"])))

    for name in HEADLINE:
        timed(name, lambda n=name: force(QUERIES[n](spark, sf_dir)))

    total = round(sum(v for k, v in times.items() if not k.startswith("fit[")), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_sec", "value": total, "unit": "sec", "queries": times, "sf": sf,
                      "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
