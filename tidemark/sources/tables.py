"""Idempotent appends to Parquet tables in shared storage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import FeedLabels
from tidemark.functions.integers import div
from tidemark.functions.staging import spread, stage
from tidemark.operators.dedup import label_arrivals
from tidemark.operators.normalize import accepted_events, raw_records
from tidemark.operators.ops import expired_records, purge_expired


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None while nothing has been written to it."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in str(missing) or "UNABLE_TO_INFER_SCHEMA" in str(missing):
            return None
        raise


EVENT_CONTENT = ("kind", "fixture_id", "source_timestamp_ms", "sequence", "fixture", "odds", "score")
DAY_MS = 86_400_000
NO_DAY = -1


@dataclass(frozen=True)
class Layout:
    """Folders of an append-only table: by day of the source time and by a hash of the key.

    An append looks keys up in the folders of its own key hashes only.  With ``horizon_days`` it also
    leaves out days further than that from the batch's own, so what a batch reads does not grow with
    history: an exact repetition has the day of its original and is always found, a conflicting re-use of a
    key if its source time is within the horizon.  None looks at all days.
    """

    key_buckets: int = 16
    horizon_days: int | None = None


PARTITIONS = ("source_day", "key_bucket")


def _placed(rows: DataFrame, key: str, layout: Layout) -> DataFrame:
    day = F.coalesce(div(F.col("source_timestamp_ms"), DAY_MS).cast("int"), F.lit(NO_DAY))
    bucket = F.pmod(F.xxhash64(key), F.lit(layout.key_buckets)).cast("int")
    return rows.withColumns({"source_day": day, "key_bucket": bucket})


def stored_beside(placed: DataFrame, path: str, layout: Layout) -> DataFrame | None:
    """The part of the table at ``path`` in which keys of ``placed`` can be; None without a table.

    The bounds are two days and at most ``key_buckets`` numbers of the batch; as literals they are
    partition filters, and other folders are not opened.
    """
    stored = read_table(placed.sparkSession, path)
    if stored is None:
        return None
    day = F.when(F.col("source_day") != NO_DAY, F.col("source_day"))
    low, high, buckets = placed.agg(F.min(day), F.max(day), F.collect_set("key_bucket")).first()
    near = stored.filter(F.col("key_bucket").isin(buckets))
    if layout.horizon_days is None:
        return near
    timeless = F.col("source_day") == NO_DAY
    if low is None:
        return near
    return near.filter(timeless | F.col("source_day").between(low - layout.horizon_days, high + layout.horizon_days))


def _append(rows: DataFrame, path: str) -> None:
    # few files a folder, and a folder that gets very many rows is split
    rows.hint("rebalance", *PARTITIONS).write.mode("append").partitionBy(*PARTITIONS).parquet(path)


def _append_conflicts(placed: DataFrame, path: str, keys: list[str], layout: Layout) -> None:
    """Append rows whose ``keys`` are not stored yet, once each."""
    fresh = placed.dropDuplicates(keys)
    stored = stored_beside(placed, path, layout)
    if stored is not None:
        fresh = fresh.join(stored.select(*keys), keys, "left_anti")
    _append(fresh, path)


def _write_labelled(labelled: DataFrame, path: str, conflicts_path: str | None, layout: Layout) -> None:
    clashing = _placed(raw_records(labelled.filter("append_status = 'conflict'")), "idempotency_key", layout)
    conflicts_path = conflicts_path or f"{path.rstrip('/')}_conflicts"
    _append_conflicts(clashing, conflicts_path, ["idempotency_key", "raw_payload_hash"], layout)
    _append(_placed(raw_records(labelled.filter("append_status IN ('inserted', 'quarantined')")), "idempotency_key", layout), path)


def write_raw(
    normalized: DataFrame, path: str, arrival: str = "arrival", conflicts_path: str | None = None, layout: Layout = Layout()
) -> None:
    """Append accepted and quarantined raw records, one per key.

    A record that re-uses a stored or earlier key with another payload goes to the conflict
    table instead, by default beside ``path``.
    """
    # dealt by the key that the labels are joined by, so what one task reads does not grow with the input
    placed = spread(_placed(normalized, "raw_key", layout), "raw_key").persist()
    labelled = label_arrivals(placed, stored_beside(placed, path, layout), arrival).persist()
    try:
        _write_labelled(labelled, path, conflicts_path, layout)
    finally:
        labelled.unpersist()
        placed.unpersist()


def write_events(events: DataFrame, path: str, conflicts_path: str | None = None, layout: Layout = Layout()) -> None:
    """Append events whose key is not stored yet, with the hash of their content.

    Of several events with one key the first received stays, ties by content.  Events with
    other content than the one stored under their key go to the conflict table.
    """
    key = "idempotency_key"
    content = F.sha2(F.to_json(F.struct(*EVENT_CONTENT)), 256)
    rated = _placed(events, key, layout).withColumn("content_hash", content).persist()
    first = rated.groupBy(key).agg(
        F.min_by(F.struct(*[c for c in rated.columns if c != key]), F.struct("received_at_ms", "content_hash")).alias("first")
    )
    stored = stored_beside(rated, path, layout)
    if stored is None:
        known = first.withColumn("stored", F.lit(None).cast("string"))
    else:
        known = first.join(stored.select(key, F.col("content_hash").alias("stored")), key, "left")
    known = known.persist()
    try:
        kept = known.select(key, F.coalesce("stored", "first.content_hash").alias("kept"))
        clashing = rated.join(kept, key).filter(F.col("content_hash") != F.col("kept")).drop("kept")
        _append_conflicts(clashing, conflicts_path or f"{path.rstrip('/')}_conflicts", [key, "content_hash"], layout)
        fresh = known.filter(F.col("stored").isNull()).select(key, "first.*")
        _append(fresh.select(*rated.columns), path)
    finally:
        known.unpersist()
        rated.unpersist()


def write_batch(
    normalized: DataFrame, raw_path: str, events_path: str, batch_id: int, arrival: str = "arrival", layout: Layout = Layout()
) -> None:
    """Both tables of one micro-batch, and their conflict tables.

    The events go first and all appends skip what is stored, so a batch that is retried
    after a failure between the writes neither loses nor repeats a record.
    """
    distinct = _placed(normalized.dropDuplicates(["raw_key", "payload_hash"]), "raw_key", layout).persist()
    labelled = label_arrivals(distinct, stored_beside(distinct, raw_path, layout), arrival)
    labelled = labelled.withColumn("batch_id", F.lit(batch_id)).persist()
    try:
        fresh = labelled.filter("append_status IN ('inserted', 'quarantined')")
        write_events(accepted_events(fresh), events_path, layout=layout)
        _write_labelled(labelled, raw_path, None, layout)
    finally:
        labelled.unpersist()
        distinct.unpersist()


def purge_table(spark: SparkSession, path: str, now_ms: int, labels: FeedLabels = FeedLabels()) -> int:
    """Drop expired payloads from a stored raw table; returns how many folders were written anew.

    Only folders that hold an expired record are read whole and replaced, all others keep their files.
    The new rows are first written beside the table, in ``<path>_purge``: from the moment that copy is
    complete, a purge that was cut off anywhere is taken up from it by the next call, so no row is
    lost.  An empty copy means that nothing is pending.  No other job may append meanwhile.
    """
    journal = f"{path.rstrip('/')}_purge"

    def replaced() -> None:
        rows = spark.read.schema(spark.read.parquet(journal).schema).parquet(journal)
        rows = rows.withColumns({c: F.col(c).cast("int") for c in PARTITIONS})
        writer = rows.hint("rebalance", *PARTITIONS).write.mode("overwrite").partitionBy(*PARTITIONS)
        writer.option("partitionOverwriteMode", "dynamic").parquet(path)
        rows.limit(0).write.mode("overwrite").parquet(journal)

    pending = read_table(spark, journal)
    if pending is not None and not pending.isEmpty():
        replaced()
    stored = read_table(spark, path)
    if stored is None:
        return 0
    touched = stored.filter(expired_records(now_ms, labels)).select(*PARTITIONS).distinct()
    count = touched.count()
    if count:
        rows = stored.join(touched, list(PARTITIONS), "left_semi")
        purge_expired(rows, now_ms, labels).drop("purged").write.mode("overwrite").parquet(journal)
        replaced()
    return count


def save_reports(reports: DataFrame, path: str) -> DataFrame:
    """Save hash-addressed reports; returns each input's status.

    Saving an equal report again is `duplicate`; the same hash with other content is
    `conflict` and is not written.
    """
    existing = read_table(reports.sparkSession, path)
    rows = reports.select("evaluation_hash", "report_json")
    if existing is None:
        statuses = rows.withColumn("stored", F.lit(None).cast("string"))
    else:
        stored = existing.select("evaluation_hash", F.col("report_json").alias("stored"))
        statuses = rows.join(stored, "evaluation_hash", "left")
    labelled = statuses.select(
        "evaluation_hash",
        "report_json",
        F.when(F.col("stored").isNull(), F.lit("inserted"))
        .when(F.col("stored") == F.col("report_json"), F.lit("duplicate"))
        .otherwise(F.lit("conflict"))
        .alias("append_status"),
    )
    # the append below changes the table that the statuses were read from
    labelled = stage(labelled)
    labelled.filter("append_status = 'inserted'").dropDuplicates(["evaluation_hash"]).select(
        "evaluation_hash", "report_json"
    ).write.mode("append").parquet(path)
    return labelled.select("evaluation_hash", "append_status")
