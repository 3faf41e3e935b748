"""Driver entry smoke and the streaming rule scorer."""

import os
import tempfile
import time

import __spark_entry__ as E
from patronus.operators import rfm
from patronus.plans import catalog
from patronus.sources.tables import tables
from patronus.streaming.scoring import score_request_stream


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[:2] == ["Segment", "Count"]


def test_queries_have_oracles_or_are_models():
    q, o = catalog.queries(), catalog.oracle_sql()
    assert set(q) <= set(E.queries()) and set(o) <= set(E.oracle_sql())
    rows_only = set(q) - set(o)
    assert rows_only <= {"model_logreg", "model_tree", "model_forest", "model_newton_boost", "model_knn",
                         "model_gbt", "smote_balance", "model_metrics", "cv_metrics", "feature_importance",
                         "model_comparison", "evaluate_saved_model", "evaluate_saved_model_summary",
                         "saved_split_info", "score_customers_model"}


def test_stream_rule_scoring_matches_batch(spark, sf_small):
    stats = rfm.rfm_stats(rfm.customer_base(tables(spark, sf_small)))
    src = tempfile.mkdtemp(prefix="patronus-stream-src-")
    with open(os.path.join(src, "a.json"), "w") as f:
        f.write('{"request_id": 1, "recency": 5, "frequency": 9, "monetary": 90000}\n')
        f.write('{"request_id": 2, "recency": null, "frequency": null, "monetary": null}\n')
    scored = score_request_stream(spark, src, stats)
    q = scored.writeStream.format("memory").queryName("scored_requests").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r.request_id: r for r in spark.sql("SELECT * FROM scored_requests").collect()}
    assert set(got) == {1, 2}
    assert got[2].churn_risk == "Low"                     # default recency 30 days
    assert got[2].avg_order_value == 100.0                 # default 500 / 5
    batch = rfm.score_rule(spark.createDataFrame([(1, 5.0, 9.0, 90000.0)],
                                                 "request_id long, recency double, frequency double, "
                                                 "monetary double"), stats).first()
    assert batch.asDict() == got[1].asDict()
    time.sleep(0)


def test_stream_file_sink_restarts(spark, sf_small):
    from patronus.streaming.scoring import start_scoring
    stats = rfm.rfm_stats(rfm.customer_base(tables(spark, sf_small)))
    src = tempfile.mkdtemp(prefix="patronus-stream-src-")
    out = tempfile.mkdtemp(prefix="patronus-stream-out-")
    ck = tempfile.mkdtemp(prefix="patronus-stream-ck-")
    with open(os.path.join(src, "a.json"), "w") as f:
        f.write('{"request_id": 1, "recency": 100, "frequency": 1, "monetary": 10}\n')
    q = start_scoring(score_request_stream(spark, src, stats), out, ck)
    q.processAllAvailable(); q.stop()
    with open(os.path.join(src, "b.json"), "w") as f:
        f.write('{"request_id": 2, "recency": 10, "frequency": 3, "monetary": 300}\n')
    q = start_scoring(score_request_stream(spark, src, stats), out, ck)   # resumes from the checkpoint
    q.processAllAvailable(); q.stop()
    got = sorted((r.request_id, r.churn_risk) for r in spark.read.parquet(out).collect())
    assert got == [(1, "High"), (2, "Low")]                              # each request exactly once
