"""Raw record sources: files or streams of JSON text, feed messages, historical buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import BUCKET_MS, FeedLabels
from tidemark.functions.integers import div
from tidemark.operators.dedup import label_arrivals
from tidemark.operators.normalize import accepted_events, normalize, quarantined

# --- fixed values -----------------------------------------------------------------
HEARTBEATS = ("heartbeat", "keepalive", "ping")
DAY_MS = 86_400_000
HOUR_MS = 3_600_000
# ----------------------------------------------------------------------------------


def _as_raw(lines: DataFrame, kind: str, source: str) -> DataFrame:
    return lines.select(
        F.lit(kind).alias("payload_kind"),
        F.lit(None).cast("int").alias("payload_version"),
        F.lit(source).alias("source"),
        F.lit(None).cast("long").alias("received_at_ms"),
        F.lit(None).cast("long").alias("sequence"),
        F.col("value").alias("payload"),
    )


def read_raw(spark: SparkSession, path: str, kind: str, source: str) -> DataFrame:
    """One raw record per line of JSON text."""
    return _as_raw(spark.read.text(path), kind, source)


def read_raw_stream(spark: SparkSession, path: str, kind: str, source: str, max_files: int = 1000) -> DataFrame:
    """Streaming form of `read_raw`; a broker source with a string ``value`` fits the same shape."""
    return _as_raw(spark.readStream.option("maxFilesPerTrigger", max_files).text(path), kind, source)


def explode_messages(messages: DataFrame) -> DataFrame:
    """Feed messages (``event``, ``data``) to payload rows.

    Heartbeats are dropped, a JSON array becomes one row per element, and text that is not
    JSON stays as it is so that normalization can quarantine it.
    """
    quiet = F.lower("event").isin(*HEARTBEATS) | F.lower(F.regexp_replace("data", r"(?U)^\s+|\s+$", "")).isin(*HEARTBEATS)
    alive = messages.filter(~F.coalesce(quiet, F.lit(False)))
    elements = F.expr(
        """CASE WHEN ltrim(data) LIKE '[%' AND try_parse_json(data) IS NOT NULL
           THEN transform(try_variant_get(try_parse_json(data), '$', 'array<variant>'), x -> to_json(x))
           ELSE array(data) END"""
    )
    others = [c for c in messages.columns if c not in ("event", "data")]
    return alive.select(*others, F.explode(elements).alias("payload"))


def bucket_cols(time_ms: Column) -> dict[str, Column]:
    """Five-minute bucket coordinates of a time: epoch day, hour, interval, start, end."""
    start = div(time_ms, BUCKET_MS) * BUCKET_MS
    return {
        "epoch_day": div(start, DAY_MS),
        "hour": div(start % DAY_MS, HOUR_MS),
        "interval": div(start % HOUR_MS, BUCKET_MS),
        "bucket_start_ms": start,
        "bucket_end_ms": start + BUCKET_MS,
    }


def plan_buckets(spark: SparkSession, start_ms: int, end_ms: int, most: int | None = None) -> DataFrame:
    """All buckets that intersect the closed range ``[start_ms, end_ms]``; more than ``most`` are refused."""
    if start_ms < 0 or end_ms < start_ms:
        raise ValueError("range must be non-negative and not reversed")
    first, last = start_ms // BUCKET_MS * BUCKET_MS, end_ms // BUCKET_MS * BUCKET_MS
    if most is not None and (last - first) // BUCKET_MS + 1 > most:
        raise ValueError(f"range exceeds {most} buckets")
    starts = spark.range(first, last + 1, BUCKET_MS).withColumnRenamed("id", "t")
    return starts.select(*[c.alias(n) for n, c in bucket_cols(F.col("t")).items()])


def plan_selection_buckets(selections: DataFrame, most: int | None = None) -> DataFrame:
    """Buckets of many selections at once: one row per (fixture, bucket), without a driver loop.

    ``valid`` is false for a reversed range or one of more than ``most`` buckets; such a
    selection yields a single row.
    """
    first = div(F.col("source_start_ms"), BUCKET_MS) * BUCKET_MS
    last = div(F.col("source_end_ms"), BUCKET_MS) * BUCKET_MS
    valid = F.col("source_end_ms") >= F.col("source_start_ms")
    if most is not None:
        valid = valid & (div(last - first, BUCKET_MS) + 1 <= most)
    starts = F.when(valid, F.sequence(first, last, F.lit(BUCKET_MS).cast("long"))).otherwise(F.array(first))
    rows = selections.select("fixture_id", valid.alias("valid"), F.explode(starts).alias("t"))
    return rows.select("fixture_id", "valid", *[c.alias(n) for n, c in bucket_cols(F.col("t")).items()])


def source_time(payload: str = "payload") -> Column:
    """Non-negative integral ``Ts`` (else ``ts``) of a payload; null when absent or invalid."""
    j = f"coalesce(nullif(to_json(variant_get(try_parse_json({payload}), '$.Ts', 'variant')), 'null'), " \
        f"to_json(variant_get(try_parse_json({payload}), '$.ts', 'variant')))"
    return F.expr(rf"CASE WHEN {j} RLIKE r'^\d{{1,15}}$' THEN cast({j} AS bigint) END")


def in_source_range(raw: DataFrame, start: Column, end: Column) -> DataFrame:
    """Keep records inside the closed range; records without a valid time pass to validation."""
    timed = raw.withColumn("source_time_ms", source_time())
    return timed.filter(F.col("source_time_ms").isNull() | F.col("source_time_ms").between(start, end))


BUCKETS = ("epoch_day", "hour", "interval")


def write_backfill(records: DataFrame, path: str, time_ms: Column, folders: Sequence[str] = BUCKETS) -> None:
    """Store records in one folder per five-minute bucket of ``time_ms``.

    A feed too sparse to fill such folders takes fewer levels, as ``("epoch_day",)``; the finer
    coordinates are then columns of the files.
    """
    placed = records.withColumns({n: c.cast("int") for n, c in bucket_cols(time_ms).items() if n in BUCKETS})
    placed.hint("rebalance", *folders).sortWithinPartitions(*BUCKETS).write.mode("append").partitionBy(*folders).parquet(path)


def stored_days(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """First and last day of a store of `write_backfill`, from one listing of its folders."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
    names = [status.getPath().getName() for status in listed]
    days = [int(n.removeprefix("epoch_day=")) for n in names if n.startswith("epoch_day=")]
    return (min(days), max(days)) if days else None


def read_backfill(spark: SparkSession, path: str, selections: DataFrame, most_buckets: int = 1_000_000) -> DataFrame:
    """The stored records of all buckets that some selection meets; files of other buckets are not opened.

    Selections are cut to the days that are stored, so the list of buckets has at most 288 rows a stored
    day.  Up to ``most_buckets`` it is broadcast and prunes folders at run time; beyond, the
    days asked for are the only filter on folders and the list is joined by shuffle.
    """
    stored = spark.read.parquet(path)
    days = stored_days(spark, path)
    low, high = selections.filter("source_end_ms >= source_start_ms").agg(F.min("source_start_ms"), F.max("source_end_ms")).first()
    if days is None or low is None:
        return stored.limit(0)
    first, last = max(days[0], low // DAY_MS), min(days[1], high // DAY_MS)
    cut = selections.select(
        "fixture_id",
        F.greatest("source_start_ms", F.lit(first * DAY_MS)).alias("source_start_ms"),
        F.least("source_end_ms", F.lit((last + 1) * DAY_MS - 1)).alias("source_end_ms"),
    )
    # one number a bucket: run-time pruning looks at each key of a join on its own
    number = (F.col("epoch_day").cast("long") * 24 + F.col("hour")) * (HOUR_MS // BUCKET_MS) + F.col("interval")
    plan = plan_selection_buckets(cut).filter("valid").select(F.col("epoch_day").cast("int").alias("wanted_day"), number.alias("wanted_bucket")).distinct()
    if (last - first + 1) * (DAY_MS // BUCKET_MS) <= most_buckets:
        plan = F.broadcast(plan)
    same = (F.col("epoch_day") == F.col("wanted_day")) & (number == F.col("wanted_bucket"))
    return stored.filter(F.col("epoch_day").between(first, last)).join(plan, same, "left_semi")


def hydrate(
    scores: DataFrame, odds: DataFrame, selections: DataFrame, labels: FeedLabels = FeedLabels(), hydrated_at_ms: int = 0
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Historical backfill of many fixtures: (events, quarantine, summary).

    ``scores`` and ``odds`` carry `fixture_id` and `payload` (and `arrival`); odds stored by
    bucket (`read_backfill`) also carry `epoch_day`, `hour`, `interval`: they meet the selections of their
    fixture day by day, and buckets outside a selection's range are skipped.  Ranges may be of any length.  A reversed selection is `refused`: its
    summary row has no records.  Records of another fixture than the selected one are counted
    as `foreign` and are not returned.
    """
    valid = F.col("source_end_ms") >= F.col("source_start_ms")
    wanted = selections.select("fixture_id", "source_start_ms", "source_end_ms").filter(valid)

    def chosen(df: DataFrame, kind: str, keys: list[str], ranges: DataFrame, *inside: Column) -> DataFrame:
        rows = df.join(ranges, keys)
        for condition in inside:
            rows = rows.filter(condition)
        return rows.select("fixture_id", "arrival", "payload", F.lit(kind).alias("payload_kind"), "source_start_ms", "source_end_ms")

    if set(BUCKETS) <= set(odds.columns):
        # a fixture with very many odds is met day by day, not in one group
        day = F.explode(F.sequence(div(F.col("source_start_ms"), DAY_MS), div(F.col("source_end_ms"), DAY_MS)))
        start = F.col("epoch_day").cast("long") * DAY_MS + F.col("hour") * HOUR_MS + F.col("interval") * BUCKET_MS
        inside = (start <= F.col("source_end_ms")) & (start + BUCKET_MS > F.col("source_start_ms"))
        quoted = chosen(odds, "odds", ["fixture_id", "epoch_day"], wanted.withColumn("epoch_day", day), inside)
    else:
        quoted = chosen(odds, "odds", ["fixture_id"], wanted)
    both = chosen(scores, "score", ["fixture_id"], wanted).unionByName(quoted)
    selected = in_source_range(both, F.col("source_start_ms"), F.col("source_end_ms"))
    raw = selected.select(
        F.col("fixture_id").alias("selected_fixture"),
        "arrival",
        "payload_kind",
        F.lit(None).cast("int").alias("payload_version"),
        F.lit(labels.historical).alias("source"),
        F.coalesce("source_time_ms", F.lit(hydrated_at_ms)).alias("received_at_ms"),
        F.lit(None).cast("long").alias("sequence"),
        "payload",
    )
    labelled = label_arrivals(normalize(raw, labels, hydrated_at_ms))
    foreign = F.col("fixture_id") != F.col("selected_fixture")
    counted = labelled.groupBy("selected_fixture").agg(
        *[F.count_if(F.col("append_status") == c).alias(c) for c in ("inserted", "duplicate", "quarantined", "conflict")],
        F.count_if(foreign).alias("foreign"),
    )
    asked = selections.select(F.col("fixture_id").alias("selected_fixture"), (~valid).alias("refused"))
    summary = asked.join(counted, "selected_fixture", "left").fillna(0)
    own = labelled.filter(F.coalesce(~foreign, F.lit(True)))
    fresh = own.filter(F.col("append_status") == "inserted")
    rejected = quarantined(own).filter(F.col("append_status") == "quarantined")
    return accepted_events(fresh), rejected, summary
