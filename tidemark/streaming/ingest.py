"""Streaming ingest: two feeds, one normalization, exactly-once appends to the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.config import FeedLabels
from tidemark.operators.normalize import normalize
from tidemark.sources.tables import write_batch


def normalized_stream(odds: DataFrame, scores: DataFrame, labels: FeedLabels = FeedLabels(), now_ms: int = 0) -> DataFrame:
    """Both raw streams through the same stateless normalization as a batch."""
    return normalize(odds.unionByName(scores), labels, now_ms)


def start_ingest(
    odds: DataFrame,
    scores: DataFrame,
    raw_path: str,
    events_path: str,
    checkpoint: str,
    labels: FeedLabels = FeedLabels(),
    now_ms: int = 0,
    trigger: dict[str, str | bool] | None = None,
) -> StreamingQuery:
    """Persist raw records and events; decisions read the event table, never the feed.

    ``trigger`` holds the arguments of the writer's trigger; by default what is there is
    taken in and the query ends, ``{"processingTime": "5 seconds"}`` keeps it running.
    Resume after a failure relies on the checkpoint and on both appends skipping keys that
    are already stored.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        # by source time, then by payload: the same order on every retry
        arrival = F.struct("source_timestamp_ms", "payload_hash")
        write_batch(batch.withColumn("arrival", arrival), raw_path, events_path, batch_id)

    stream = normalized_stream(odds, scores, labels, now_ms)
    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
