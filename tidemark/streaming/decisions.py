"""Live decisions: a stream over the event table that yields the decisions of the batch job.

Three stateful operators run in one query.  The first holds the events of a fixture for a
while and releases them in event order, with the current quotes of the market they belong to;
the second gives every event the market and the snapshot it is judged by; the third folds
each market under each policy.  Snapshots, features, reasons, hashes and ids are the Columns of the
batch job in between.  An event that comes too late changes nothing and leaves by a side output.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemark.config import RISK_POLICY_VERSION, ConsensusConfig, RiskPolicy
from tidemark.functions.scans import chunk_of
from tidemark.operators import automaton
from tidemark.operators.classify import SIGNAL_FIELDS, score_signal
from tidemark.operators.consensus import assemble_snapshots, finish_snapshots, normalize_vectors
from tidemark.operators.risk import decision_rows, fold_inputs, snapshot_features
from tidemark.schemas import EVENTS_DDL, ORDER_FIELDS, event_order, schema
from tidemark.streaming.consensus import BODY_DDL, QUOTE_DDL, SNAPSHOT_DDL

# processors travel inside the task, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_NUMBERS = ("source_timestamp_ms", "sequence", "source_priority")
_ORDER_DDL = f"STRUCT<{', '.join(f'{f}: {_type}' for f, _type in zip(ORDER_FIELDS, ('BIGINT', 'BIGINT', 'INT', 'STRING', 'STRING', 'STRING')))}>"
_SIGNAL_DDL = f"STRUCT<{', '.join(f'{f}: STRING' for f in SIGNAL_FIELDS)}>"
_FEATURES_DDL = (
    "STRUCT<consensus_status: STRING, fresh_bookmaker_count: BIGINT, max_abs_velocity: BIGINT, max_dispersion: BIGINT, "
    "max_reaction_latency_ms: BIGINT, oldest_fresh_age_ms: BIGINT, stale_ppm: BIGINT, unreacted_count: BIGINT>"
)
_EVENT_DDL = f"event_id STRING, fixture_id STRING, kind STRING, t BIGINT, chunk BIGINT, ord {_ORDER_DDL}, signal {_SIGNAL_DDL}"
_JUDGED_DDL = (
    f"event_id STRING, fixture_id STRING, kind STRING, chunk BIGINT, ord {_ORDER_DDL}, signal {_SIGNAL_DDL}, features {_FEATURES_DDL}, "
    "proof_status STRING, pause_reasons ARRAY<STRING>, widen_reasons ARRAY<STRING>, policy_configuration_hash STRING"
)
_HELD_DDL = "place STRING, t BIGINT, event_id STRING, own_market STRING, bookmaker_id STRING, quote STRING, event STRING"
_HELD = [c.split()[0] for c in _HELD_DDL.split(", ")]
_RELEASED_DDL = (
    "fixture_id STRING, place STRING, event STRING, feed_status STRING, own_market STRING, t BIGINT, superseded BOOLEAN, latest_json STRING"
)
_PLACED_DDL = (
    "fixture_id STRING, place STRING, event STRING, feed_status STRING, market_id STRING, snapshot STRING, previous STRING"
)
_CONTROL_DDL = "state STRING, change_ms BIGINT, stable BIGINT, shock_until_ms BIGINT, version BIGINT, last_t BIGINT, restored STRING"
FOLDED_DDL = (
    "market_id STRING, policy_id STRING, status STRING, t BIGINT, last_applied_ms BIGINT, judged STRING, state_version BIGINT, "
    "shock_until_ms BIGINT, previous_shock_ms BIGINT, previous_t BIGINT, pause BOOLEAN, widen BOOLEAN, " + automaton.STATE_DDL
)


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def place(order: Column) -> Column:
    """The event order as one text that compares in the same way: nulls first, numbers by value."""
    parts = []
    for name in ORDER_FIELDS:
        if name in _NUMBERS:
            shifted = order[name].cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")
            text = F.lpad(shifted.cast("decimal(20,0)").cast("string"), 20, "0")
        else:
            text = F.concat(F.lit("1"), order[name])
        parts.append(F.coalesce(text, F.lit("")))
    return F.concat_ws("\x01", *parts)


def _ordered(frames: Iterator[pd.DataFrame], columns: list[str]) -> list[tuple]:
    """The rows of one key in one micro-batch, by their place, the first column."""
    rows = [r for frame in frames for r in frame[columns].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: r[0])


class OrderedFeed(StatefulProcessor):
    """Releases the events of a fixture in event order once they are ``delay_ms`` behind its newest one.

    What is held is bounded by the events of that span.  An event older than the last release is
    late.  Quotes are kept per market, one of each bookmaker.
    """

    def __init__(self, delay_ms: int) -> None:
        self.delay_ms = delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", _HELD_DDL)
        self.clock = handle.getValueState("clock", "released BIGINT")
        self.quotes = handle.getMapState("quotes", "market_id STRING", "current STRING, last_t BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = _ordered(rows, _HELD)
        before = self.clock.get()[0] if self.clock.exists() else None
        late = [r for r in fresh if before is not None and r[1] < before]
        waiting = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        waiting = sorted([*waiting, *[r for r in fresh if before is None or r[1] >= before]], key=lambda r: r[0])
        released = max([r[1] for r in waiting] + [before + self.delay_ms if before is not None else 0]) - self.delay_ms
        due = [r for r in waiting if r[1] <= released]
        keep = [r for r in waiting if r[1] > released]
        self.clock.update((int(released),))
        if keep:
            self.held.put(keep)
        elif self.held.exists():
            self.held.clear()
        books: dict[str, tuple[dict, int | None]] = {}
        out = [(key[0], r[0], r[6], "late", r[3], None, None, None) for r in late]
        for at, _, event_id, market, bookmaker, quote, event in due:
            if quote is None:
                out.append((key[0], at, event, "live", market, None, None, None))
                continue
            if market not in books:
                stored = self.quotes.getValue((market,)) if self.quotes.containsKey((market,)) else None
                books[market] = (json.loads(stored[0]), stored[1]) if stored else ({}, None)
            current, last_t = books[market]
            observed = int(json.loads(quote)["observed_at_ms"])
            own = current.get(bookmaker)
            superseded = own is not None and (observed, event_id) <= (own[0], own[1])
            if not superseded:
                current[bookmaker] = (observed, event_id, quote)
                last_t = observed
                books[market] = (current, last_t)
            latest = "[" + ",".join(q[2] for q in current.values()) + "]"
            out.append((key[0], at, event, "live", market, last_t, superseded, latest))
        for market, (current, last_t) in books.items():
            self.quotes.updateValue((market,), (json.dumps(current), last_t))
        yield pd.DataFrame(out, columns=_names(_RELEASED_DDL)).astype({"t": "Int64"})

    def close(self) -> None:
        pass


class Placement(StatefulProcessor):
    """Market and snapshots of every event of a fixture: its own market's, else the last observed one's.

    Events before the first observation of their fixture are dropped, as there is no market yet.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.chains = handle.getMapState("chains", "market_id STRING", "snapshot STRING, previous STRING")
        self.latest = handle.getValueState("latest", "market_id STRING, snapshot STRING, previous STRING")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        columns = ["place", "event", "feed_status", "own_market", "superseded", "snapshot"]
        latest = tuple(self.latest.get()) if self.latest.exists() else None
        chains: dict[str, tuple] = {}
        out = []
        for at, event, status, own, superseded, snapshot in _ordered(rows, columns):
            if status == "late":
                out.append((key[0], at, event, status, own or (latest[0] if latest else ""), None, None))
                continue
            if snapshot is not None:
                if own not in chains:
                    chains[own] = self.chains.getValue((own,)) if self.chains.containsKey((own,)) else (None, None)
                if not superseded:
                    chains[own] = (snapshot, chains[own][0])
                latest = (own, *chains[own])
            if latest is not None:
                out.append((key[0], at, event, status, own or latest[0], latest[1], latest[2]))
        for market, chain in chains.items():
            self.chains.updateValue((market,), chain)
        if latest is not None:
            self.latest.update(latest)
        yield pd.DataFrame(out, columns=_names(_PLACED_DDL))

    def close(self) -> None:
        pass


_FOLD = [
    "place", "t", "feed_status", "judged", "pause_signal", "reversal", "market_pause", "widen", "healthy",
    "critical_shock_hold_ms", "reversal_shock_hold_ms", *automaton.FOLD_LIMITS,
]


class LiveFold(StatefulProcessor):
    """The automaton of one market and policy; what was decided before a restart is passed over."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.control = handle.getValueState("control", _CONTROL_DDL)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = self.control.get() if self.control.exists() else None
        auto, shock, version, last_t, restored = None, 0, 0, 0, None
        if stored is not None:
            state, change, stable, shock, version, last_t, restored = stored
            auto = automaton.Automaton(state, change, stable)
        out = []
        for at, t, status, judged, signal, reversal, market_pause, widen, healthy, critical, reverse, *limits in _ordered(rows, _FOLD):
            if restored is not None and at <= restored:
                continue
            if status == "late" or t < last_t:
                out.append((*key, "late", t, last_t, judged, *[None] * 13))
                continue
            auto = auto or automaton.Automaton("OPEN", t, 0)
            was = (auto.state, auto.stable, auto.change_ms, shock, last_t)
            if reversal:
                shock = t + reverse
            elif signal:
                shock = max(shock, t + critical)
            pause = bool(signal or market_pause or shock > t)
            action = auto.step(t, pause, bool(widen), bool(healthy), limits)
            out.append(
                (*key, "applied", t, t, judged, version, shock, was[3], was[4], pause, bool(widen))
                + (was[0], auto.state, action, auto.stable, auto.change_ms, was[1], was[2])
            )
            version, last_t = version + 1, t
        if auto is not None:
            numbers = (int(auto.change_ms), int(auto.stable), int(shock), int(version), int(last_t))
            self.control.update((auto.state, *numbers, restored))
        frame = pd.DataFrame(out, columns=_names(FOLDED_DDL))
        yield frame.astype({c.split()[0]: "Int64" for c in FOLDED_DDL.split(", ") if c.endswith(" BIGINT")})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        numbers = [int(r[c]) for c in ("change_ms", "stable", "shock_until_ms", "version", "last_t")]
        self.control.update((r["state"], *numbers, r["restored"]))

    def close(self) -> None:
        pass


def restart_states(decisions: DataFrame) -> DataFrame:
    """State of every market and policy after its last stored decision, for `live_decisions`."""
    last = F.max_by(F.struct("next_state", "expected_state_version", "logical_timestamp_ms", "metrics", "ord"), "expected_state_version")
    return decisions.groupBy("market_id", "policy_id").agg(last.alias("d")).select(
        "market_id",
        "policy_id",
        F.col("d.next_state").alias("state"),
        F.col("d.metrics.last_state_change_at_ms").alias("change_ms"),
        F.col("d.metrics.recovery_stable_updates").alias("stable"),
        F.col("d.metrics.shock_until_ms").alias("shock_until_ms"),
        (F.col("d.expected_state_version") + 1).alias("version"),
        F.col("d.logical_timestamp_ms").alias("last_t"),
        place(F.col("d.ord")).alias("restored"),
    )


def _prepared(events: DataFrame, config: ConsensusConfig) -> DataFrame:
    """Events with their place, signal and, where they quote probabilities, their normalized quote."""
    odds = F.col("odds")
    is_quote = (F.col("kind") == "odds.observed") & (F.col("payload_version") == 2)
    outcome = lambda o: F.struct(
        o["outcome_id"].alias("outcome_id"), o["name"].alias("name"), o["reported_probability_micros"].alias("reported_micros")
    )
    timed = events.select(
        "event_id",
        "fixture_id",
        "kind",
        F.col("source_timestamp_ms").alias("t"),
        F.col("source_timestamp_ms").alias("observed_at_ms"),
        chunk_of(F.col("source_timestamp_ms"), config.chunk_ms).alias("chunk"),
        event_order().alias("ord"),
        F.expr(f"CASE WHEN kind = 'score.observed' THEN {score_signal()} END").alias("signal"),
        odds["market"]["market_id"].alias("own_market"),
        odds["bookmaker"]["id"].alias("bookmaker_id"),
        F.coalesce(is_quote, F.lit(False)).alias("is_quote"),
        F.transform(odds["outcomes"], outcome).alias("outcomes"),
    )
    quote = F.struct("observed_at_ms", "event_id", "bookmaker_id", "code", "signature", "vector")
    return normalize_vectors(timed).select(
        "fixture_id",
        place(F.col("ord")).alias("place"),
        "t",
        "event_id",
        "own_market",
        "bookmaker_id",
        F.when(F.col("is_quote"), F.to_json(quote)).alias("quote"),
        F.to_json(F.struct(*_names_of(_EVENT_DDL))).alias("event"),
    )


def _names_of(ddl: str) -> list[str]:
    return schema(ddl).names


def live_decisions(
    events: DataFrame,
    config: ConsensusConfig,
    policies: dict[str, RiskPolicy],
    delay_ms: int = 0,
    proof_status: str = "unavailable",
    initial: DataFrame | None = None,
) -> DataFrame:
    """Folded inputs of a stream of events, one row per event and policy; see `decided` and `late_rows`.

    ``delay_ms`` is how far an event may be behind the newest one of its fixture and still take its
    place in order; up to that far the order of arrival does not matter.  ``initial`` is the result of
    `restart_states`: events at or before a market's restored place are passed over.  A row of a
    fixture's later events is what releases its earlier ones.  Needs the RocksDB state store.
    """
    released = _prepared(events, config).groupBy("fixture_id").transformWithStateInPandas(
        statefulProcessor=OrderedFeed(delay_ms), outputStructType=_RELEASED_DDL, outputMode="Append", timeMode="None"
    )
    listed = released.withColumn("latest", F.from_json("latest_json", f"ARRAY<STRUCT<{QUOTE_DDL}>>")).drop("latest_json")
    snapshots = assemble_snapshots(listed, config)
    body = F.to_json(F.struct(*_names_of(BODY_DDL)))
    kept = ["fixture_id", "place", "event", "feed_status", "own_market", "superseded"]
    chained = snapshots.select(*kept, F.when(F.col("superseded").isNotNull(), body).alias("snapshot"))
    placed = chained.groupBy("fixture_id").transformWithStateInPandas(
        statefulProcessor=Placement(), outputStructType=_PLACED_DDL, outputMode="Append", timeMode="None"
    )
    opened = placed.select(
        "market_id", "place", "feed_status", F.from_json("event", _EVENT_DDL).alias("e"),
        F.from_json("snapshot", BODY_DDL).alias("s"), F.from_json("previous", SNAPSHOT_DDL).alias("before"),
    )
    rows = opened.select("market_id", "place", "feed_status", "e", "s.*", "before")
    featured = finish_snapshots(rows, config, "before").select(
        "market_id", "place", "feed_status", *[F.col(f"e.{n}").alias(n) for n in _names_of(_EVENT_DDL)], snapshot_features().alias("features")
    )
    judged = fold_inputs(featured, policies, proof_status, ["place", "feed_status"])
    packed = judged.withColumn("judged", F.to_json(F.struct(*_names_of(_JUDGED_DDL)))).select("market_id", "policy_id", *_FOLD)
    seed = None if initial is None else initial.groupBy("market_id", "policy_id")
    return packed.groupBy("market_id", "policy_id").transformWithStateInPandas(
        statefulProcessor=LiveFold(), outputStructType=FOLDED_DDL, outputMode="Append", timeMode="None", initialState=seed
    )


def decided(folded: DataFrame, policy_version: str = RISK_POLICY_VERSION) -> DataFrame:
    """The decisions among the rows of `live_decisions`, as `risk.decide` gives them."""
    judged = folded.filter("status = 'applied'").withColumn("j", F.from_json("judged", _JUDGED_DDL)).drop("judged", "status", "last_applied_ms")
    opened = judged.select("*", "j.*").drop("j")
    hold = F.array_compact(F.array(F.when(F.col("shock_until_ms") > F.col("t"), F.lit("EVENT_SHOCK_HOLD"))))
    return decision_rows(opened.withColumn("pause_reasons", F.concat("pause_reasons", hold)), policy_version)


def late_rows(folded: DataFrame) -> DataFrame:
    """The events that came too late: reported, never applied."""
    return folded.filter("status = 'late'").select(
        "market_id", "policy_id", F.get_json_object("judged", "$.event_id").alias("event_id"), "t", "last_applied_ms", "status"
    )


def start_decisions(
    spark: SparkSession,
    events_path: str,
    decisions_path: str,
    late_path: str,
    checkpoint: str,
    config: ConsensusConfig,
    policies: dict[str, RiskPolicy],
    delay_ms: int = 0,
    policy_version: str = RISK_POLICY_VERSION,
    initial: DataFrame | None = None,
    trigger: dict[str, str | bool] | None = None,
    max_files: int = 1000,
) -> StreamingQuery:
    """Decide on what is in the event table and what is appended to it; raw feeds are never read.

    Each micro-batch replaces its own folder below ``decisions_path`` and ``late_path``, so a retried
    batch neither repeats nor loses a row and nothing already stored is read.  The counts of applied
    and late rows are observed metrics of the query (``live``).  By default what is there is decided and
    the query ends.  After the loss of a checkpoint start with ``initial`` and a new checkpoint.
    """
    events = spark.readStream.schema(schema(EVENTS_DDL)).option("maxFilesPerTrigger", max_files).parquet(events_path)
    folded = live_decisions(events, config, policies, delay_ms, initial=initial).observe(
        "live", F.count_if(F.col("status") == "applied").alias("applied"), F.count_if(F.col("status") == "late").alias("late")
    )

    def store(batch: DataFrame, batch_id: int) -> None:
        query_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        held = batch.persist()
        try:
            for rows, path in ((decided(held, policy_version), decisions_path), (late_rows(held), late_path)):
                rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/query={query_id}/batch={batch_id}")
        finally:
            held.unpersist()

    writer = folded.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
