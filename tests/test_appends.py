"""Ingest keeps what it is given: conflicts, long ranges, foreign records, oversized numbers."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import staging
from tidemark.operators import normalize as norm
from tidemark.operators import ops, risk
from tidemark.plans import feed_queries
from tidemark.sources import raw as raw_source
from tidemark.sources import sample_feed as feed
from tidemark.sources import tables

SF = "/root/testdata/sf0.001"
RAW = "arrival bigint, payload_kind string, payload_version int, source string, received_at_ms bigint, sequence bigint, payload string"


def odds(message="m1", prices=(100, 200), ts=1_000, fixture=1, **other):
    record = {
        "Bookmaker": "B", "BookmakerId": 1, "FixtureId": fixture, "InRunning": True, "MessageId": message,
        "PriceNames": [f"o{k}" for k in range(len(prices))], "Prices": list(prices), "SuperOddsType": "1X2", "Ts": ts,
    }
    return json.dumps(record | other)


def normalized(spark, payloads, kind="odds"):
    rows = [(k, kind, None, "live", 5_000 + k, None, p) for k, p in enumerate(payloads)]
    return norm.normalize(spark.createDataFrame(rows, RAW))


def test_conflicting_records_are_set_aside(spark, tmp_path):
    raw, events = str(tmp_path / "raw"), str(tmp_path / "events")
    first = normalized(spark, [odds(), odds(prices=(101, 200)), odds("m2")])
    for _ in range(2):  # the same batch again changes nothing
        tables.write_batch(first, raw, events, 0)
    tables.write_batch(normalized(spark, [odds(prices=(102, 200)), odds("m2")]), raw, events, 1)
    assert spark.read.parquet(raw).count() == 2 and spark.read.parquet(events).count() == 2
    clashes = spark.read.parquet(raw + "_conflicts").select("raw_payload").collect()
    assert sorted(json.loads(r[0])["Prices"][0] for r in clashes) == [101, 102]


def test_events_of_one_key_have_one_winner(spark, tmp_path):
    path = str(tmp_path / "events")
    event = norm.accepted_events(normalized(spark, [odds()]))
    later = event.withColumn("received_at_ms", F.col("received_at_ms") + 1).withColumn("sequence", F.lit(9).cast("long"))
    for rows in (later.unionByName(event), later):
        tables.write_events(rows, path)
    assert [r["sequence"] for r in spark.read.parquet(path).collect()] == [0]
    assert [r["sequence"] for r in spark.read.parquet(path + "_conflicts").collect()] == [9]


def test_oversized_numbers_are_kept_or_quarantined(spark):
    long = "9" * 20
    texts = [
        odds("a", (3_000_000_000, 1)), odds("b", (int(long), 1)), odds("c", Pct=[long + ".000", "1.000"]), odds("d", Pct=["9999999999999999.000", "NA"]),
        odds("e", Pct=["000000000000000000050.000", "NA"]), odds("f", Pct=["100.000", "0.000"]), odds("g", Pct=["100.001", "0.000"]),
    ]
    got = {r["source_id"]: r for r in normalized(spark, texts).collect()}
    assert {k: r["quarantine_code"] for k, r in got.items() if r["quarantine_code"]} == dict.fromkeys("bcdg", "malformed_payload")
    assert [o["price"] for o in got["a"]["odds"]["outcomes"]] == [3_000_000_000, 1]
    assert [o["reported_probability_micros"] for o in got["e"]["odds"]["outcomes"]] == [500_000, None]
    score = {"action": "status", "fixtureId": 1, "seq": 1, "ts": 1, "stats": {long: 1}}
    fine = score | {"stats": {"1001": 2}, "seq": 2}
    codes = [r["quarantine_code"] for r in normalized(spark, [json.dumps(score), json.dumps(fine)], "score").orderBy("arrival").collect()]
    assert codes == ["malformed_payload", None]


def test_hydration_has_no_range_limit_and_returns_no_foreign_events(spark):
    times = [10, 3_180_000_000 // 2, 3_180_000_000]  # 10,600 buckets of five minutes
    rows = [("7", k, odds(f"m{k}", ts=t, fixture=7), t) for k, t in enumerate(times)] + [("7", 3, odds("x", ts=20, fixture=8), 20)]
    records = spark.createDataFrame(rows, "fixture_id string, arrival bigint, payload string, t bigint")
    stored = records.withColumns(raw_source.bucket_cols(F.col("t"))).drop("t")
    none = records.limit(0).drop("t")
    chosen = spark.createDataFrame([("7", 0, 3_180_000_000), ("9", 5, 4)], "fixture_id string, source_start_ms bigint, source_end_ms bigint")
    for source in (stored, records.drop("t")):
        events, _, summary = raw_source.hydrate(none, source, chosen)
        assert sorted(r["source_timestamp_ms"] for r in events.collect()) == times
        got = {r["selected_fixture"]: (r["refused"], r["inserted"], r["foreign"]) for r in summary.collect()}
        assert got == {"7": (False, 4, 1), "9": (True, 0, 0)}


def test_a_market_folds_in_many_segments(spark):
    t = feed_queries.FeedTables(spark, "/root/testdata/sf0.01")
    cut = risk.segments(t.inputs, {"base": feed.POLICY})
    row = cut.agg(F.count_distinct("seg_key").alias("segments"), F.count_distinct("market_id").alias("markets")).first()
    assert row["segments"] > 3 * row["markets"]


def test_percentiles_over_many_ranges(spark):
    log = spark.createDataFrame([((k * 7919) % 100_003,) for k in range(5_000)], "duration_ms bigint")
    values = sorted(r[0] for r in log.collect())
    got = ops.latency_percentiles(log).first()
    assert (got["p50"], got["p95"], got["maximum"]) == (values[2_500], values[4_750], values[-1])
    assert ops.latency_percentiles(log.limit(0)).first()["maximum"] is None


def test_a_cluster_without_shared_folder_is_refused(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None

        @staticmethod
        def getConf():
            return {}

    class Session:
        sparkContext = Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.ensure_checkpoint_dir(Session)
