"""Operational data jobs: retention, feed health, request metrics, latency percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import FeedLabels


def expired_records(now_ms: int, labels: FeedLabels = FeedLabels()) -> Column:
    """True for historical records with a hash whose payload is to go by ``now_ms``."""
    return (
        (F.col("source") == labels.historical)
        & F.col("payload_retained")
        & F.col("raw_payload_hash").isNotNull()
        & (F.col("retention_expires_at_ms") <= now_ms)
    )


def purge_expired(raw: DataFrame, now_ms: int, labels: FeedLabels = FeedLabels()) -> DataFrame:
    """Drop the payload of expired historical records that keep a hash; identity stays.

    A row-local rewrite; `purge_table` applies it to the folders of a stored table.
    """
    gone = F.coalesce(expired_records(now_ms, labels), F.lit(False))
    return raw.withColumns(
        {
            "purged": gone,
            "raw_payload": F.when(~gone, F.col("raw_payload")),
            "payload_retained": F.col("payload_retained") & ~gone,
        }
    )


def _health_aggs(now_ms: int) -> list:
    status = F.col("append_status")
    last = F.max("source_timestamp_ms")
    return [
        F.count_if(status == "inserted").alias("accepted"),
        F.count_if(status == "duplicate").alias("duplicates"),
        F.count_if(~status.isin("inserted", "duplicate")).alias("quarantined"),
        last.alias("last_source_ms"),
        F.greatest(F.lit(0).cast("long"), F.lit(now_ms) - last).alias("lag_ms"),
    ]


def feed_health(ingest_log: DataFrame, now_ms: int) -> DataFrame:
    """Counters per feed: accepted, duplicate, quarantined, lag and number of fixtures tracked."""
    fixtures = F.count_distinct("fixture_id").alias("tracked_fixtures")
    return ingest_log.groupBy("payload_kind").agg(*_health_aggs(now_ms), fixtures)


def tracked_fixtures(ingest_log: DataFrame) -> DataFrame:
    """The fixtures each feed has seen, one row each."""
    return ingest_log.filter("fixture_id IS NOT NULL").select("payload_kind", "fixture_id").distinct()


def bucketed_feed_health(ingest_log: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Feed counters per five-minute bucket, for a stream or a table."""
    timed = ingest_log.withColumn("event_time", F.timestamp_millis("source_timestamp_ms"))
    if timed.isStreaming:
        timed = timed.withWatermark("event_time", delay)
    status = F.col("append_status")
    grouped = timed.groupBy(F.window("event_time", "5 minutes").alias("w"), "payload_kind").agg(
        F.count_if(status == "inserted").alias("accepted"),
        F.count_if(status == "duplicate").alias("duplicates"),
        F.count_if(~status.isin("inserted", "duplicate")).alias("quarantined"),
    )
    return grouped.select(F.unix_millis("w.start").alias("bucket_start_ms"), "payload_kind", "accepted", "duplicates", "quarantined")


def request_metrics(log: DataFrame) -> DataFrame:
    """Totals over a request log (`status_code`, `duration_ms`)."""
    code, duration = F.col("status_code"), F.greatest(F.lit(0), F.col("duration_ms"))
    return log.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(code.between(400, 499)).alias("client_errors"),
        F.count_if(code >= 500).alias("server_errors"),
        F.coalesce(F.sum(duration), F.lit(0)).alias("total_duration_ms"),
        F.coalesce(F.max(duration), F.lit(0)).alias("maximum_duration_ms"),
    )


RANGE_MS = 4_096


def latency_percentiles(log: DataFrame, fractions: tuple[tuple[str, float], ...] = (("p50", 0.5), ("p95", 0.95))) -> DataFrame:
    """Value at index floor(n * f), at most n - 1, of the sorted durations, and the maximum.

    Exact without a global sort: durations are counted per distinct value, values are summed
    up inside ranges of ``RANGE_MS``, and only the ranges' totals meet in one window.
    """
    histogram = log.groupBy("duration_ms").agg(F.count(F.lit(1)).alias("c")).withColumn("span", F.floor(F.col("duration_ms") / RANGE_MS))
    totals = histogram.groupBy("span").agg(F.sum("c").alias("own"))
    before = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = totals.select("span", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("below"))
    everything = totals.agg(F.sum("own").alias("n"))
    inside = Window.partitionBy("span").orderBy("duration_ms").rowsBetween(Window.unboundedPreceding, 0)
    # one row holds the grand total
    ranked = histogram.join(spans, "span").withColumn("upto", F.col("below") + F.sum("c").over(inside)).join(everything, F.lit(True))

    def at(fraction: float):
        index = F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(fraction)))
        return F.min(F.when(F.col("upto") > index, F.col("duration_ms")))

    return ranked.agg(*[at(f).alias(name) for name, f in fractions], F.max("duration_ms").alias("maximum"))
