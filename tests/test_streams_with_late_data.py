"""Watermarked streams end to end: duplicates inside and outside the delay, buckets that close, saved reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import dedup, ops
from tidemark.sources import tables

MINUTE = 60_000
START = 1_704_067_200_000  # a full hour
LOG = "raw_key string, payload_kind string, append_status string, source_timestamp_ms bigint"


def _drain(spark, tmp_path, frames, transform, schema):
    """One micro-batch a frame through ``transform``."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        transform(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck"))
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination(240)
    return spark.read.parquet(out)


def _log(spark, *rows):
    return spark.createDataFrame([(k, "odds", s, START + m * MINUTE) for k, s, m in rows], LOG)


def test_duplicates_within_the_delay_go_and_state_is_forgotten_after_it(spark, tmp_path):
    frames = [
        _log(spark, ("a", "inserted", 0), ("b", "inserted", 1), ("a", "inserted", 0)),
        _log(spark, ("a", "inserted", 5), ("c", "inserted", 8)),  # a again, within ten minutes
        _log(spark, ("d", "inserted", 60)),  # the watermark passes all of the above,
        _log(spark, ("d", "inserted", 60)),  # and holds for the batch after the next
        _log(spark, ("a", "inserted", 61), ("b", "inserted", 62), ("e", "inserted", 1)),  # a and b anew; e is too late
    ]
    got = _drain(spark, tmp_path, frames, dedup.dedup_stream, frames[0].schema)
    found = sorted((r["raw_key"], (r["source_timestamp_ms"] - START) // MINUTE) for r in got.collect())
    assert found == [("a", 0), ("a", 61), ("b", 1), ("b", 62), ("c", 8), ("d", 60)]


def test_health_buckets_close_and_late_rows_do_not_reopen_them(spark, tmp_path):
    frames = [
        _log(spark, ("a", "inserted", 0), ("b", "duplicate", 1)),
        _log(spark, ("c", "quarantined", 3), ("d", "inserted", 7)),  # late for nothing: the delay is ten minutes
        _log(spark, ("e", "conflict", 31)),  # closes the first two buckets
        _log(spark, ("e2", "inserted", 33)),
        _log(spark, ("f", "inserted", 2), ("g", "inserted", 32)),  # f comes after its bucket has closed
        _log(spark, ("h", "inserted", 90)),
    ]
    got = _drain(spark, tmp_path, frames, ops.bucketed_feed_health, frames[0].schema)
    columns = ("accepted", "duplicates", "quarantined")
    found = {(r["bucket_start_ms"] - START) // MINUTE: tuple(r[c] for c in columns) for r in got.collect()}
    assert found == {0: (1, 1, 1), 5: (1, 0, 0), 30: (2, 0, 1)}  # the bucket of h is still open
    table = frames[0].unionAll(frames[1])
    batch = {(r["bucket_start_ms"] - START) // MINUTE: tuple(r[c] for c in columns) for r in ops.bucketed_feed_health(table).collect()}
    assert batch == {k: found[k] for k in (0, 5)}


def test_reports_are_saved_once(spark, tmp_path):
    path = str(tmp_path / "reports")
    make = lambda *rows: spark.createDataFrame(rows, "evaluation_hash string, report_json string")
    status = lambda df: sorted((r["evaluation_hash"], r["append_status"]) for r in df.collect())
    assert status(tables.save_reports(make(("h1", "{}"), ("h2", "[1]")), path)) == [("h1", "inserted"), ("h2", "inserted")]
    again = make(("h1", "{}"), ("h2", "[2]"), ("h3", "{}"))
    assert status(tables.save_reports(again, path)) == [("h1", "duplicate"), ("h2", "conflict"), ("h3", "inserted")]
    stored = {r["evaluation_hash"]: r["report_json"] for r in spark.read.parquet(path).collect()}
    assert stored == {"h1": "{}", "h2": "[1]", "h3": "{}"} and spark.read.parquet(path).select(F.count("*")).first()[0] == 3
