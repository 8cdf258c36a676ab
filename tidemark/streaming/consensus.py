"""Stateful running consensus of a stream: current quotes per market, snapshots as in batch.

Only the bookkeeping is stateful -- which quote of each bookmaker is current, and what the
previous snapshot of the market was.  The arithmetic of a snapshot stays in the same Column
expressions as the batch job, applied before and after the two small processors.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.config import ConsensusConfig
from tidemark.operators.consensus import assemble_snapshots, finish_snapshots, normalize_vectors, quote_vectors
from tidemark.schemas import ORDER_FIELDS

# processors travel inside the task, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_VECTOR = "ARRAY<STRUCT<outcome_id: STRING, name: STRING, micros: BIGINT, probability_micros: BIGINT>>"
QUOTE_DDL = f"observed_at_ms BIGINT, event_id STRING, bookmaker_id STRING, code STRING, signature STRING, vector {_VECTOR}"
# the event order of a row travels with it: rows of one millisecond need all of its fields
_ORDER = [f"ord_{f}" for f in ORDER_FIELDS]
_NUMBERS = ("source_timestamp_ms", "sequence", "source_priority")
_ORDER_DDL = ", ".join(f"ord_{f} {'BIGINT' if f in _NUMBERS else 'STRING'}" for f in ORDER_FIELDS)
CURRENT_DDL = f"market_id STRING, event_id STRING, t BIGINT, superseded BOOLEAN, latest_json STRING, {_ORDER_DDL}"
_QUOTE = ("observed_at_ms", "event_id", "bookmaker_id")


class CurrentQuotes(StatefulProcessor):
    """Keeps the current quote of each bookmaker of one market, as JSON text.

    Emits, per quote in event order, the list of current quotes.  A superseded quote changes
    nothing and repeats the list and the time of the last snapshot.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.quotes = handle.getMapState("quotes", "bookmaker_id STRING", "observed_at_ms BIGINT, event_id STRING, quote STRING")
        self.last = handle.getValueState("last", "t BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(_ORDER)
        current = {k[0]: v for k, v in self.quotes.iterator()}
        last_t = self.last.get()[0] if self.last.exists() else None
        out = []
        for row in batch.itertuples(index=False):
            held = current.get(row.bookmaker_id)
            superseded = held is not None and (row.observed_at_ms, row.event_id) <= (held[0], held[1])
            if not superseded:
                current[row.bookmaker_id] = (int(row.observed_at_ms), row.event_id, row.quote)
                self.quotes.updateValue((row.bookmaker_id,), current[row.bookmaker_id])
                last_t = int(row.observed_at_ms)
            latest = "[" + ",".join(q[2] for q in current.values()) + "]"
            out.append((key[0], row.event_id, last_t, superseded, latest, *[getattr(row, c) for c in _ORDER]))
        self.last.update((last_t,))
        yield pd.DataFrame(out, columns=["market_id", "event_id", "t", "superseded", "latest_json", *_ORDER])

    def close(self) -> None:
        pass


class PreviousSnapshots(StatefulProcessor):
    """Attaches the preceding snapshot of the market, as JSON text, to each snapshot."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("previous", "snapshot STRING, before STRING")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(_ORDER)
        last, before = self.state.get() if self.state.exists() else (None, None)
        out = []
        for row in batch.itertuples(index=False):
            if not row.superseded:
                before, last = last, row.snapshot
            out.append((key[0], row.event_id, row.snapshot, row.superseded, before))
        self.state.update((last, before))
        yield pd.DataFrame(out, columns=["market_id", "event_id", "snapshot", "superseded", "previous"])

    def close(self) -> None:
        pass


def current_quote_stream(events: DataFrame) -> DataFrame:
    """Stream of (market, trigger, current quotes) from the event stream."""
    vectors = normalize_vectors(quote_vectors(events))
    quote = F.struct("observed_at_ms", "event_id", "bookmaker_id", "code", "signature", "vector")
    keyed = vectors.select(
        "market_id", *_QUOTE, *[F.col(f"ord.{f}").cast("long" if f in _NUMBERS else "string").alias(f"ord_{f}") for f in ORDER_FIELDS],
        F.to_json(quote).alias("quote"),
    )
    return keyed.groupBy("market_id").transformWithStateInPandas(
        statefulProcessor=CurrentQuotes(), outputStructType=CURRENT_DDL, outputMode="Append", timeMode="None"
    )


def snapshots_from_current(current: DataFrame, config: ConsensusConfig) -> DataFrame:
    """Snapshots without deltas for rows of `current_quote_stream`; stateless."""
    parsed = current.withColumn("latest", F.from_json("latest_json", f"ARRAY<STRUCT<{QUOTE_DDL}>>")).drop("latest_json")
    return assemble_snapshots(parsed, config)


SNAPSHOT_DDL = (
    "status STRING, t BIGINT, base_outcomes ARRAY<STRUCT<outcome_id: STRING, name: STRING, probability_micros: BIGINT, "
    "dispersion_micros: BIGINT>>"
)
BODY_DDL = (
    SNAPSHOT_DDL + ", fresh_bookmaker_count INT, valid_bookmaker_count INT, stale_bookmaker_count INT, total_bookmaker_count INT, "
    "stale_ppm BIGINT, freshest_age_ms BIGINT, oldest_fresh_age_ms BIGINT, "
    "diagnostics ARRAY<STRUCT<code: STRING, bookmaker_id: STRING, event_id: STRING>>, quote_event_ids ARRAY<STRING>"
)


def consensus_stream(events: DataFrame, config: ConsensusConfig) -> DataFrame:
    """Running consensus of a stream; equals `consensus_trace` over the same events."""
    snaps = snapshots_from_current(current_quote_stream(events), config)
    body = [c.strip().split()[0] for c in ("status", "t", "base_outcomes")] + [
        "fresh_bookmaker_count", "valid_bookmaker_count", "stale_bookmaker_count", "total_bookmaker_count", "stale_ppm",
        "freshest_age_ms", "oldest_fresh_age_ms", "diagnostics", "quote_event_ids",
    ]
    packed = snaps.select("market_id", "event_id", "superseded", *_ORDER, F.to_json(F.struct(*body)).alias("snapshot"))
    chained = packed.groupBy("market_id").transformWithStateInPandas(
        statefulProcessor=PreviousSnapshots(),
        outputStructType="market_id STRING, event_id STRING, snapshot STRING, superseded BOOLEAN, previous STRING",
        outputMode="Append",
        timeMode="None",
    )
    opened = chained.select(
        "market_id", "event_id", "superseded", F.from_json("snapshot", BODY_DDL).alias("s"),
        F.from_json("previous", SNAPSHOT_DDL).alias("previous"),
    ).select("market_id", "event_id", "superseded", "s.*", "previous")
    return finish_snapshots(opened, config, "previous").drop("previous")
