"""Replay manifests, run logs and the audits that tie a replay to its input."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import FeedLabels, ReplayConfig, canonical_text
from tidemark.functions import canonical as cj
from tidemark.functions.integers import div
from tidemark.functions.scans import Running, chunk_of, running
from tidemark.operators import digests
from tidemark.schemas import event_order

cloudpickle.register_pickle_by_value(digests)

# --- fixed values -----------------------------------------------------------------
RUN_MOVES = {
    "completed": ("completed",),
    "failed": ("failed",),
    "paused": ("paused", "running", "stopped", "failed"),
    "pending": ("pending", "running", "stopped", "failed"),
    "running": ("running", "paused", "completed", "stopped", "failed"),
    "stopped": ("stopped",),
}
RUN_CONSTANTS = (
    "config_hash", "input_fixture_id", "input_hash", "manifest_id", "namespace", "run_id", "speed", "started_at_ms",
)
OPEN_RUNS = ("pending", "running", "paused")
# ----------------------------------------------------------------------------------


def _participant_json() -> str:
    return cj.obj({"id": cj.text("p.id"), "name": cj.text("p.name"), "role": cj.plain("p.role")})


def payload_json(labels: FeedLabels = FeedLabels()) -> str:
    """Canonical JSON of an event's payload."""
    fixture = cj.obj(
        {
            "competition": cj.text("fixture.competition"),
            "competitionId": cj.text("fixture.competition_id"),
            "fixtureId": cj.text("fixture.fixture_id"),
            "participants": cj.items("fixture.participants", "p", _participant_json()),
            "scheduledAtMs": cj.scalar("fixture.scheduled_at_ms"),
            "status": cj.plain("fixture.status"),
        }
    )

    def odds(version: int) -> str:
        outcome = {"name": cj.text("o.name"), "outcomeId": cj.text("o.outcome_id"), "price": cj.scalar("o.price")}
        if version == 2:
            outcome["reportedProbabilityMicros"] = cj.scalar("o.reported_probability_micros")
        fields = {
            "bookmaker": cj.obj({"id": cj.text("odds.bookmaker.id"), "name": cj.text("odds.bookmaker.name")}),
            "fixtureId": cj.text("odds.fixture_id"),
            "market": cj.obj(
                {
                    "gameState": cj.text("odds.market.game_state"),
                    "inRunning": cj.scalar("odds.market.in_running"),
                    "marketId": cj.text("odds.market.market_id"),
                    "parameters": cj.text("odds.market.parameters"),
                    "period": cj.text("odds.market.period"),
                    "status": cj.plain("odds.market.status"),
                    "type": cj.text("odds.market.type"),
                }
            ),
            "outcomes": cj.items("odds.outcomes", "o", cj.obj(outcome)),
            "priceEncoding": cj.plain(cj.literal(labels.price_encoding)),
        }
        if version == 2:
            fields["probabilityEncoding"] = cj.plain(cj.literal(labels.probability_encoding))
        return cj.obj(fields)

    def score(version: int) -> str:
        stat = cj.obj({"key": cj.scalar("x.key"), "period": cj.scalar("x.period"), "value": cj.scalar("x.value")})
        fields = {
            "action": cj.text("score.action"),
            "awayScore": cj.scalar("score.away_score"),
            "fixtureId": cj.text("score.fixture_id"),
            "homeScore": cj.scalar("score.home_score"),
            "period": cj.scalar("score.period"),
            "stats": cj.items("score.stats", "x", stat),
            "statusId": cj.scalar("score.status_id"),
        }
        if version == 2:
            d = "score.details"
            fields |= {
                "actionId": cj.text("score.action_id"),
                "confirmed": cj.scalar("score.confirmed"),
                "details": cj.obj(
                    {
                        "amendedAction": cj.text(f"{d}.amended_action"),
                        "outcome": cj.text(f"{d}.outcome"),
                        "possible": cj.obj(
                            {
                                "goal": cj.scalar(f"{d}.possible.goal"),
                                "penalty": cj.scalar(f"{d}.possible.penalty"),
                                "redCard": cj.scalar(f"{d}.possible.red_card"),
                                "review": cj.scalar(f"{d}.possible.review"),
                            }
                        ),
                        "referencedActionId": cj.text(f"{d}.referenced_action_id"),
                        "reliable": cj.scalar(f"{d}.reliable"),
                        "reviewType": cj.text(f"{d}.review_type"),
                    }
                ),
            }
        return cj.obj(fields)

    return f"""CASE WHEN kind = 'fixture.observed' THEN {fixture}
        WHEN kind = 'odds.observed' AND payload_version = 2 THEN {odds(2)} WHEN kind = 'odds.observed' THEN {odds(1)}
        WHEN payload_version = 2 THEN {score(2)} ELSE {score(1)} END"""


def fact_json(labels: FeedLabels = FeedLabels()) -> str:
    """Canonical JSON of everything that identifies an event; reception time is left out."""
    return cj.obj(
        {
            "eventId": cj.text("event_id"),
            "fixtureId": cj.text("fixture_id"),
            "idempotencyKey": cj.text("idempotency_key"),
            "kind": cj.plain("kind"),
            "payload": payload_json(labels),
            "payloadVersion": cj.scalar("payload_version"),
            "sequence": cj.scalar("sequence"),
            "source": cj.plain("source"),
            "sourceId": cj.text("source_id"),
            "sourcePriority": cj.scalar("source_priority"),
            "sourceTimestampMs": cj.scalar("source_timestamp_ms"),
        }
    )


# label of the two-level digest; it enters the identity of manifests that use it
CHUNKED = "chunked-sha256-v1"


def chunked_hash(events: DataFrame, labels: FeedLabels = FeedLabels(), chunk_ms: int = 300_000) -> DataFrame:
    """Per fixture: event count, and two-level hashes of the ordered ids and of the ordered facts.

    The events of a time chunk are hashed in order, then the hashes of the chunks.  No task
    sees more of a fixture than a chunk's events, or one short row a chunk.
    """
    rendered = events.select(
        "fixture_id",
        chunk_of(F.col("source_timestamp_ms"), chunk_ms).alias("chunk"),
        F.struct(event_order().alias("ord"), F.expr(cj.text("event_id")).alias("id"), F.sha2(F.expr(fact_json(labels)), 256).alias("fact")).alias("e"),
    )

    def listed(column: str, field: str):
        return F.sha2(F.concat(F.lit("["), F.array_join(F.transform(column, lambda x: x[field]), ","), F.lit("]")), 256)

    chunks = rendered.groupBy("fixture_id", "chunk").agg(F.array_sort(F.collect_list("e")).alias("es"))
    hashed = chunks.select("fixture_id", F.struct("chunk", F.size("es").alias("n"), listed("es", "id").alias("id"), listed("es", "fact").alias("fact")).alias("c"))
    fixtures = hashed.groupBy("fixture_id").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    return fixtures.select(
        "fixture_id",
        F.aggregate("cs", F.lit(0).cast("bigint"), lambda n, c: n + c["n"]).alias("event_count"),
        listed("cs", "id").alias("event_sequence_hash"),
        listed("cs", "fact").alias("input_hash"),
    )


def sequence_hash(events: DataFrame, labels: FeedLabels = FeedLabels()) -> DataFrame:
    """Per fixture: event count, hash of the ordered ids, hash of the ordered facts.

    The parity form of `chunked_hash`: the hash of a list is sequential by definition, so one
    task digests one fixture; it streams sorted rows in constant memory and nothing is
    collected.  Rendering the JSON, the expensive part, runs before the shuffle on all tasks.
    """
    rendered = events.select(
        "fixture_id", event_order().alias("ord"), F.expr(cj.text("event_id")).alias("id_json"), F.expr(fact_json(labels)).alias("fact_json")
    )
    arranged = rendered.repartition("fixture_id").sortWithinPartitions("fixture_id", "ord")
    schema = "fixture_id string, event_count long, event_sequence_hash string, input_hash string"
    return arranged.select("fixture_id", "id_json", "fact_json").mapInPandas(digests.list_digests, schema)


def _hashes(events: DataFrame, labels: FeedLabels, form: str) -> DataFrame:
    if form not in ("chunked", "sequential"):
        raise ValueError("form is 'chunked' or 'sequential'")
    return (chunked_hash if form == "chunked" else sequence_hash)(events, labels)


def manifests(
    events: DataFrame, fixtures: DataFrame, config: ReplayConfig, labels: FeedLabels = FeedLabels(), form: str = "chunked"
) -> DataFrame:
    """Manifest per fixture.  ``fixtures``: fixture_id, competition_id, scheduled_at_ms, source_start_ms,
    source_end_ms and intervals_json (canonical JSON of the planned buckets, ``[]`` for none).

    ``form``: the two-level ``chunked`` hashes, or ``sequential`` ones for ids that agree with
    deployments that hash the plain list.
    """
    hashed = fixtures.join(_hashes(events, labels, form), "fixture_id")
    simulated = config.data_mode == "seeded-simulation"
    path = "'null'" if simulated else cj.text(f"concat({cj.literal(config.score_path_prefix)}, fixture_id)")
    strategy = cj.literal(canonical_text(config.strategy))
    identity = cj.obj(
        {
            "configuration": cj.obj(
                {
                    "normalizerVersion": cj.text(cj.literal(config.normalizer_version)),
                    "orderingVersion": cj.text(cj.literal(config.ordering_version)),
                    "strategy": strategy,
                    "strategyHash": cj.plain(cj.literal(config.strategy_hash)),
                    "strategyVersion": cj.text(cj.literal(config.strategy_version)),
                }
            ),
            "eventCount": cj.scalar("event_count"),
            "eventSequenceHash": cj.plain("event_sequence_hash"),
            "fixture": cj.obj(
                {
                    "competitionId": cj.text("competition_id"),
                    "fixtureId": cj.text("fixture_id"),
                    "scheduledAtMs": cj.scalar("scheduled_at_ms"),
                }
            ),
            **({"hashForm": cj.text(cj.literal(CHUNKED))} if form == "chunked" else {}),
            "inputHash": cj.plain("input_hash"),
            "manifestVersion": "'1'",
            "source": cj.obj(
                {
                    "dataMode": cj.plain(cj.literal(config.data_mode)),
                    "endMs": cj.scalar("source_end_ms"),
                    "oddsIntervals": "intervals_json",
                    "scorePath": path,
                    "startMs": cj.scalar("source_start_ms"),
                }
            ),
        }
    )
    return hashed.select(
        F.expr(cj.short_id("rplm_", identity)).alias("manifest_id"),
        "fixture_id",
        "competition_id",
        "scheduled_at_ms",
        "source_start_ms",
        "source_end_ms",
        "event_count",
        "event_sequence_hash",
        "input_hash",
        F.lit(config.strategy_hash).alias("strategy_hash"),
        F.lit(config.strategy_version).alias("strategy_version"),
        F.lit(config.data_mode).alias("data_mode"),
    )


def manifest_violations(
    events: DataFrame, manifest_rows: DataFrame, labels: FeedLabels = FeedLabels(), form: str = "chunked"
) -> DataFrame:
    """Fixtures whose events no longer match their manifest of the same ``form``."""
    actual = _hashes(events, labels, form).select(
        "fixture_id",
        F.col("event_count").alias("actual_count"),
        F.col("event_sequence_hash").alias("actual_sequence"),
        F.col("input_hash").alias("actual_input"),
    )
    repeated = events.groupBy("fixture_id", "event_id").count().filter("count > 1").groupBy("fixture_id").agg(F.count("*").alias("repeated_ids"))
    joined = manifest_rows.join(actual, "fixture_id", "full").join(repeated, "fixture_id", "left")
    issues = F.expr(
        """array_compact(array(
            CASE WHEN manifest_id IS NULL THEN 'foreign fixture' END,
            CASE WHEN coalesce(repeated_ids, 0) > 0 THEN 'duplicate event ids' END,
            CASE WHEN manifest_id IS NOT NULL AND NOT event_count <=> coalesce(actual_count, 0) THEN 'event count' END,
            CASE WHEN manifest_id IS NOT NULL AND NOT event_sequence_hash <=> actual_sequence THEN 'sequence hash' END,
            CASE WHEN manifest_id IS NOT NULL AND NOT input_hash <=> actual_input THEN 'input hash' END))"""
    )
    return joined.select("fixture_id", "manifest_id", issues.alias("violations")).filter(F.size("violations") > 0)


def run_violations(run_log: DataFrame, manifest_rows: DataFrame) -> DataFrame:
    """Run updates that break the lifecycle.  ``run_log`` carries `update_seq` per run."""
    previous = F.struct("status", "event_count", *[c for c in RUN_CONSTANTS if c != "run_id"])
    chunked = run_log.withColumn("__chunk", div(F.col("update_seq"), 1000))
    chained = running(chunked, ["run_id"], "update_seq", "__chunk", [Running("p", "last", previous, inclusive=False)])
    limits = manifest_rows.select("manifest_id", F.col("event_count").alias("manifest_count"))
    joined = chained.join(limits, "manifest_id", "left")
    moves = " OR ".join(
        f"(p.status = '{a}' AND status IN ({', '.join(repr(b) for b in after)}))" for a, after in RUN_MOVES.items()
    )
    same = " AND ".join(f"p.{c} <=> {c}" for c in RUN_CONSTANTS if c != "run_id")
    issues = F.expr(
        f"""array_compact(array(
            CASE WHEN p IS NOT NULL AND NOT ({moves}) THEN 'illegal status move' END,
            CASE WHEN p IS NOT NULL AND NOT ({same}) THEN 'immutable field changed' END,
            CASE WHEN event_count < p.event_count THEN 'progress moved backwards' END,
            CASE WHEN manifest_count IS NULL THEN 'unknown manifest' END,
            CASE WHEN event_count > manifest_count THEN 'progress beyond manifest' END,
            CASE WHEN status = 'completed' AND (event_count <> manifest_count OR (event_count > 0 AND last_event_id IS NULL))
                THEN 'completed early' END,
            CASE WHEN namespace <> concat('replay:', run_id) THEN 'namespace not derived' END,
            CASE WHEN status IN ('completed', 'stopped', 'failed') AND completed_at_ms IS NULL
                THEN 'terminal without completion time' END))"""
    )
    return joined.select("run_id", "update_seq", issues.alias("violations")).filter(F.size("violations") > 0)


def reconcile_runs(runs: DataFrame, now_ms: int) -> DataFrame:
    """Runs left open by a stopped process fail at ``now_ms``, but never before they started."""
    orphan = F.col("status").isin(*OPEN_RUNS)
    return runs.withColumns(
        {
            "completed_at_ms": F.when(orphan, F.greatest(F.lit(now_ms), F.col("started_at_ms"))).otherwise(F.col("completed_at_ms")),
            "recovered": orphan,
            "status": F.when(orphan, F.lit("failed")).otherwise(F.col("status")),
        }
    )


def replay_order(events: DataFrame, run_id: str, chunk_ms: int = 300_000) -> DataFrame:
    """Dispatch order of a replay: index, logical time and namespace per event."""
    rows = events.select(
        "fixture_id",
        "event_id",
        F.col("source_timestamp_ms").alias("logical_timestamp_ms"),
        event_order().alias("ord"),
        chunk_of(F.col("source_timestamp_ms"), chunk_ms).alias("chunk"),
    )
    count = Running("dispatch_index", "sum", F.lit(1).cast("long"), inclusive=False)
    indexed = running(rows, ["fixture_id"], "ord", "chunk", [count])
    return indexed.select(
        "fixture_id", "event_id", "dispatch_index", "logical_timestamp_ms", F.lit(f"replay:{run_id}").alias("namespace")
    )


def hydration_summary(labelled: DataFrame) -> DataFrame:
    """Counts per fixture and append status."""
    return labelled.groupBy("fixture_id", "append_status").agg(F.count(F.lit(1)).alias("records"))
