"""Live decisions: stream equals batch under disorder, late rows leave by the side, restarts go on."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.functions.staging import stage
from tidemark.operators import consensus as con
from tidemark.operators import risk
from tidemark.schemas import ORDER_FIELDS
from tidemark.sources import sample_feed as feed
from tidemark.streaming import decisions as live
from tests.seeded import seeded_events

SF = "/root/testdata/sf0.001"
POLICIES = {"base": feed.POLICY, "short_hold": feed.POLICY.but(critical_shock_hold_ms=6_912_000)}
FIELDS = ("policy_id", "decision_id", "market_id", "action", "previous_state", "next_state", "input_feature_hash")


def _rows(decisions):
    picked = decisions.select(
        *FIELDS, "expected_state_version", F.array_join("reason_codes", ",").alias("reasons"), F.to_json("metrics").alias("metrics"),
        F.to_json("signal").alias("signal"), "trigger_event_id", "logical_timestamp_ms", "policy_configuration_hash",
    )
    return sorted(tuple(r) for r in picked.collect())


def _batch(events, policies=POLICIES):
    trace = con.consensus_trace(events, feed.CONSENSUS)
    return risk.decide(risk.risk_inputs(events, trace, feed.CONSENSUS), policies)


def _closing(events, after_ms):
    """An event of every fixture so much later that all before it are released."""
    last = events.groupBy("fixture_id").agg(F.max_by(F.struct(*events.columns), "source_timestamp_ms").alias("e"))
    late = last.select("e.*").withColumns({
        "source_timestamp_ms": F.col("source_timestamp_ms") + after_ms + 1, "event_id": F.concat(F.lit("close-"), "fixture_id"),
        "kind": F.lit("fixture.observed"), "odds": F.lit(None).cast(events.schema["odds"].dataType),
        "score": F.lit(None).cast(events.schema["score"].dataType),
    })
    return late


@pytest.fixture(scope="module")
def events(spark):
    """A few fixtures with many rows of equal time, as the true feed has them."""
    wanted = feed.events(spark, SF).filter("fixture_id IN ('1', '4', '7')")
    coarse = F.floor(F.col("source_timestamp_ms") / 21_600_000) * 21_600_000
    found = wanted.withColumn("source_timestamp_ms", coarse.cast("long"))
    return stage(found)


def _write(frames, path):
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(path)


def _run(spark, tmp_path, name, delay_ms=0, initial=None, max_files=1, policies=POLICIES, out="decisions"):
    query = live.start_decisions(
        spark, str(tmp_path / "events"), str(tmp_path / out), str(tmp_path / "late"), str(tmp_path / name),
        feed.CONSENSUS, policies, delay_ms, initial=initial, max_files=max_files,
    )
    query.awaitTermination(400)
    assert query.exception() is None
    return query


def test_stream_equals_batch_under_shuffled_files_and_equal_times(spark, events, tmp_path):
    low, high = events.agg(F.min("source_timestamp_ms"), F.max("source_timestamp_ms")).first()
    width = (high - low) // 5 + 1
    number = F.floor((F.col("source_timestamp_ms") - low) / width)
    # half of every slice travels with the next one, and each file is shuffled
    late_half = F.when(F.crc32(F.col("event_id").cast("binary")) % 2 == 0, number + 1).otherwise(number)
    slices = [events.filter(late_half == k).orderBy(F.xxhash64("event_id")) for k in range(6)]
    _write([*slices, _closing(events, 2 * width)], str(tmp_path / "events"))
    _run(spark, tmp_path, "ck", 2 * width)
    want = _rows(_batch(events))
    assert len(want) > 200 and len({r[1] for r in want}) == len(want)
    assert _rows(spark.read.parquet(str(tmp_path / "decisions"))) == want
    assert spark.read.parquet(str(tmp_path / "late")).count() == 0


def test_late_events_change_nothing_and_are_reported(spark, events, tmp_path):
    low, high = events.agg(F.min("source_timestamp_ms"), F.max("source_timestamp_ms")).first()
    held_back = F.crc32(F.col("event_id").cast("binary")) % 9 == 0
    early = (F.col("source_timestamp_ms") < (low + high) // 2) & held_back
    middle = F.col("source_timestamp_ms") < (low + high) // 2
    _write([events.filter(middle & ~early), events.filter(~middle), events.filter(early)], str(tmp_path / "events"))
    query = _run(spark, tmp_path, "ck")
    assert _rows(spark.read.parquet(str(tmp_path / "decisions"))) == _rows(_batch(events.filter(~early)))
    late = spark.read.parquet(str(tmp_path / "late"))
    want = {r["event_id"] for r in events.filter(early).collect()}
    assert want and {r["event_id"] for r in late.collect()} == want and late.count() == len(want) * len(POLICIES)
    assert late.filter("last_applied_ms > t AND status = 'late'").count() == late.count()
    counts = [p.observedMetrics["live"] for p in query.recentProgress if "live" in p.observedMetrics]
    assert sum(c["late"] for c in counts) == late.count()
    assert sum(c["applied"] for c in counts) == spark.read.parquet(str(tmp_path / "decisions")).count()


def test_restart_from_the_decision_table(spark, events, tmp_path):
    low, high = events.agg(F.min("source_timestamp_ms"), F.max("source_timestamp_ms")).first()
    first = F.col("source_timestamp_ms") < (low + high) // 2
    _write([events.filter(first)], str(tmp_path / "events"))
    _run(spark, tmp_path, "ck1")
    stored = spark.read.parquet(str(tmp_path / "decisions"))
    before = stored.count()
    _write([events.filter(~first)], str(tmp_path / "events"))
    # the checkpoint is lost: a new one reads the whole event table again
    _run(spark, tmp_path, "ck2", initial=live.restart_states(stored))
    after = spark.read.parquet(str(tmp_path / "decisions"))
    assert 0 < before < after.count() and _rows(after) == _rows(_batch(events))
    assert after.select("query").distinct().count() == 2
    # the same checkpoint again: nothing is new
    _run(spark, tmp_path, "ck2", initial=live.restart_states(stored))
    assert spark.read.parquet(str(tmp_path / "decisions")).count() == after.count()


def test_seeded_scenario_live(spark, tmp_path):
    seeded = seeded_events(spark)
    _write([seeded], str(tmp_path / "events"))
    policies = {"base": feed.POLICY}
    _run(spark, tmp_path, "ck", policies=policies)
    assert _rows(spark.read.parquet(str(tmp_path / "decisions"))) == _rows(_batch(seeded, policies))


def test_place_compares_as_the_event_order_does(spark):
    rows = [(5, None, 1, "b", "k", "e"), (5, -3, 1, "b", "k", "e"), (5, 10, 1, "b", "k", "e"), (5, 9, 1, "b", "k", "e"), (5, 9, 1, "bb", "k", "e"),
            (5, 9, 1, None, "k", "e"), (50, 0, 0, "a", "k", "e"), (5, 9, 1, "é", "k", "e"), (5, 9, 1, "z", "k", "e")]
    frame = spark.createDataFrame(rows, "source_timestamp_ms long, sequence long, source_priority int, source_id string, idempotency_key string, event_id string")
    order = F.struct(*ORDER_FIELDS)
    by_struct = [tuple(r) for r in frame.orderBy(order).collect()]
    by_text = [tuple(r) for r in frame.select("*", live.place(order).alias("p")).collect()]
    assert [r[:6] for r in sorted(by_text, key=lambda r: r[6])] == by_struct
