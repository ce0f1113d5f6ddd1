import tempfile

from pyspark.sql import functions as F

from tablesmith.operators import prepare as T
from tablesmith.operators import profile as P
from tablesmith.operators.models import catalogue as M
from tablesmith.operators.models.naive_bayes import GaussianNB
from tablesmith.operators.quantiles import exact_quantiles
from tablesmith.operators.score import score
from tablesmith.plans import report as R
from tablesmith.plans.workflow import run
from tablesmith.sources import bundle as B
from tablesmith.sources.tables import read_table
from tablesmith.streaming.score_stream import source, start_scoring

SF = "/root/testdata/sf0.001"


def test_approx_options(spark):
    li = read_table(spark, SF, "lineitem")
    ex = exact_quantiles(li, ["l_quantity"], [0.5])["l_quantity"][0]
    ap = exact_quantiles(li, ["l_quantity"], [0.5], accuracy=10_000)["l_quantity"][0]
    assert abs(ex - ap) <= 1.0
    a = {r.feature: r.distinct for r in P.semantic_types(li, approx_rsd=0.01).collect()}
    e = {r.feature: r.distinct for r in P.semantic_types(li).collect()}
    assert all(abs(a[k] - e[k]) <= max(2, 0.05 * e[k]) for k in e)


def test_stream_scoring_equals_batch(spark):
    ev = read_table(spark, SF, "events")
    cfg = T.PrepConfig(target="event_type", features=("value", "user_id"), key=("event_id",))
    prep = T.prepare(ev, cfg, keep=["event_id"])
    model = GaussianNB().fit(prep.train)
    base = tempfile.mkdtemp(prefix="ts-stream-", dir="/tmp")
    q = start_scoring(prep, model, source(spark, f"{SF}/events*.parquet", ev.schema), f"{base}/out",
                      f"{base}/ckpt", keep=["event_id"])
    q.awaitTermination()
    streamed = spark.read.parquet(f"{base}/out").select("event_id", "predicted_class")
    batch = score(prep, model, ev, keep=["event_id"]).select("event_id", "predicted_class")
    assert streamed.count() == ev.count() and streamed.exceptAll(batch).count() == 0


def test_bundle_roundtrip_knn(spark):
    ev = read_table(spark, SF, "events")
    cfg = T.PrepConfig(target="event_type", features=("value", "user_id"), key=("event_id",))
    prep = T.prepare(ev, cfg, keep=["event_id"])
    tr = M.train_one("K-Nearest Neighbors", prep.train)
    path = tempfile.mkdtemp(prefix="ts-bundle-", dir="/tmp") + "/b"
    B.save_bundle(path, prep, tr, {"f1": 0.5})
    prep2, tr2, meta = B.load_bundle(spark, path)
    a = score(prep, tr.model, ev.limit(50), keep=["event_id"]).select("event_id", "predicted_class")
    b = score(prep2, tr2.model, ev.limit(50), keep=["event_id"]).select("event_id", "predicted_class")
    assert a.exceptAll(b).count() == 0 and meta["metrics"]["f1"] == 0.5


def test_workflow_report(spark):
    li = read_table(spark, SF, "lineitem")
    cfg = T.PrepConfig(target="l_linestatus", features=("l_quantity", "l_discount", "l_returnflag"),
                       key=("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    res = run(li, cfg, models=["Naive Bayes", "Rule-Based"])
    sections = [r.section for r in res.report.select("section").distinct().collect()]
    assert set(sections) >= {"Table", "Profile", "Scores", "Choice", "Run"}
    md = R.to_markdown(res.report).first()[0]
    assert md.startswith("# Classification report") and "## Scores" in md
    assert res.comparison.count() == 2
    assert res.comparison.where(F.col("roc_auc").isNotNull()).count() == 2  # binary target: AUC present
