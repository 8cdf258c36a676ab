"""Batch and stream agree on the same events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config import RiskPolicy
from tidemark.functions.integers import div
from tidemark.operators import consensus as con
from tidemark.operators import normalize as norm
from tidemark.operators import risk
from tidemark.sources import sample_feed as feed
from tidemark.sources import raw as raw_source
from tidemark.streaming import consensus as stream_con
from tidemark.streaming import fold, ingest

SF = "/root/testdata/sf0.001"


def _drain(df, tmp_path, name):
    query = (
        df.writeStream.format("parquet")
        .option("path", str(tmp_path / name))
        .option("checkpointLocation", str(tmp_path / f"{name}-ck"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(240)
    return df.sparkSession.read.parquet(str(tmp_path / name))


def _slices(df, tmp_path, name, time="source_timestamp_ms", parts=3):
    """Write ``df`` as files in time order, so that every micro-batch is one slice."""
    lo, hi = df.agg(F.min(time), F.max(time)).head()
    width = (hi - lo) // parts + 1
    path = str(tmp_path / name)
    for i in range(parts):
        df.filter(div(F.col(time) - lo, width) == i).coalesce(1).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_running_consensus_stream_equals_batch(spark, tmp_path):
    events = feed.events(spark, SF).filter("fixture_id IN ('1', '4')")
    batch = con.consensus_trace(events, feed.CONSENSUS)
    streamed = _drain(stream_con.consensus_stream(_slices(events, tmp_path, "in"), feed.CONSENSUS), tmp_path, "out")
    want = {tuple(r) for r in batch.select("event_id", "consensus_id", "superseded").collect()}
    got = {tuple(r) for r in streamed.select("event_id", "consensus_id", "superseded").collect()}
    assert len(want) > 50
    assert got == want


def test_risk_fold_stream_equals_batch_and_reports_late(spark, tmp_path):
    events = feed.events(spark, SF).filter("fixture_id IN ('1', '4', '7')")
    trace = con.consensus_trace(events, feed.CONSENSUS)
    inputs = risk.risk_inputs(events, trace, feed.CONSENSUS)
    policy: RiskPolicy = feed.POLICY
    batch = risk.decide(inputs, {"base": policy})
    rows = risk.fold_inputs(inputs, {"base": policy})
    streamed = _drain(fold.fold_stream(_slices(rows, tmp_path, "in", time="t")), tmp_path, "out")
    want = {
        tuple(r)
        for r in batch.select(
            "market_id", "trigger_event_id", "expected_state_version", "previous_state", "next_state", "metrics.shock_until_ms"
        ).collect()
    }
    got = {
        tuple(r)
        for r in streamed.select("market_id", "event_id", "state_version", "previous_state", "next_state", "shock_until_ms").collect()
    }
    assert got == want


def test_ingest_stream_is_idempotent(spark, tmp_path):
    raw = feed.raw_feed(spark, SF).filter("arrival < 300")
    for kind in ("odds", "score"):
        raw.filter(F.col("payload_kind") == kind).select(F.col("payload").alias("value")).coalesce(1).write.text(str(tmp_path / kind))
    def run(checkpoint):
        odds = raw_source.read_raw_stream(spark, str(tmp_path / "odds"), "odds", "live")
        scores = raw_source.read_raw_stream(spark, str(tmp_path / "score"), "score", "live")
        query = ingest.start_ingest(odds, scores, str(tmp_path / "raw"), str(tmp_path / "events"), str(tmp_path / checkpoint))
        query.awaitTermination(240)
    run("ck1")
    run("ck2")  # the whole feed again, as after a lost checkpoint
    batch = norm.normalize(raw.filter("payload_kind IN ('odds', 'score')")).filter("quarantine_code IS NULL")
    want = {r[0] for r in batch.select("event_id").distinct().collect()}
    stored = [r[0] for r in spark.read.parquet(str(tmp_path / "events")).select("event_id").collect()]
    assert len(stored) == len(set(stored)) and set(stored) == want
    kept = spark.read.parquet(str(tmp_path / "raw"))
    assert kept.count() == kept.select("idempotency_key").distinct().count()
