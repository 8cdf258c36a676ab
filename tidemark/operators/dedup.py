"""Idempotent appends: duplicates are labelled, conflicting re-use of a key never passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import canonical_text
from tidemark.functions import canonical as cj


def label_arrivals(normalized: DataFrame, existing: DataFrame | None = None, arrival: str = "arrival") -> DataFrame:
    """Label every raw record `inserted`, `duplicate`, `quarantined` or `conflict`.

    The first record of a key in arrival order wins; later ones with the same payload hash
    are duplicates.  ``existing`` is the raw table already stored.  The winner is found by an
    aggregate with map-side combine, so a key that repeats a billion times shuffles one row
    per task; the labels come from a join that may split a hot key.
    """
    first = normalized.groupBy("raw_key").agg(
        F.min_by(F.struct("payload_hash", arrival), arrival).alias("w")
    ).select("raw_key", F.col("w.payload_hash").alias("first_hash"), F.col(f"w.{arrival}").alias("first_arrival"))
    joined = normalized.join(first, "raw_key")
    if existing is None:
        joined = joined.withColumn("stored_hash", F.lit(None).cast("string"))
    else:
        stored = existing.select(F.col("idempotency_key").alias("raw_key"), F.col("raw_payload_hash").alias("stored_hash"))
        joined = joined.join(stored, "raw_key", "left")
    known = F.coalesce("stored_hash", "first_hash")
    is_first = F.col("stored_hash").isNull() & (F.col(arrival) == F.col("first_arrival"))
    status = (
        F.when(is_first & F.col("quarantine_code").isNull(), F.lit("inserted"))
        .when(is_first, F.lit("quarantined"))
        .when(F.col("payload_hash") == known, F.lit("duplicate"))
        .otherwise(F.lit("conflict"))
    )
    return joined.withColumn("append_status", status).drop("first_hash", "first_arrival", "stored_hash")


def key_conflicts(records: DataFrame, key: str, payload_hash: str) -> DataFrame:
    """Keys that appear with more than one payload hash."""
    # min and max of the hash tell whether all agree, with constant state per key
    return (
        records.groupBy(key)
        .agg(F.min(payload_hash).alias("lo"), F.max(payload_hash).alias("hi"), F.count(F.lit(1)).alias("records"))
        .filter("lo <> hi")
        .select(key, "records")
    )


def raw_conflicts(normalized: DataFrame) -> DataFrame:
    return key_conflicts(normalized, "raw_key", "payload_hash")


def event_conflicts(normalized: DataFrame) -> DataFrame:
    """Event keys that arrive under more than one raw key."""
    return key_conflicts(normalized.filter("event_key IS NOT NULL"), "event_key", "raw_key")


# --- fixed values: names in the canonical decision payload ------------------------------
_DECISION_TEXT = {
    "action": "action",
    "decisionId": "decision_id",
    "fixtureId": "fixture_id",
    "inputFeatureHash": "input_feature_hash",
    "marketId": "market_id",
    "nextState": "next_state",
    "policyConfigurationHash": "policy_configuration_hash",
    "policyVersion": "policy_version",
    "previousState": "previous_state",
    "triggerEventId": "trigger_event_id",
}
_METRIC_JSON = {
    "activeShockRemainingMs": "active_shock_remaining_ms",
    "freshBookmakerCount": "fresh_bookmaker_count",
    "lastStateChangeAtMs": "last_state_change_at_ms",
    "maxAbsVelocityMicrosPerSecond": "max_abs_velocity_micros_per_second",
    "maxDispersionMadMicros": "max_dispersion_mad_micros",
    "maxReactionLatencyMs": "max_reaction_latency_ms",
    "oldestFreshQuoteAgeMs": "oldest_fresh_quote_age_ms",
    "proofStatus": "proof_status",
    "recoveryStableUpdates": "recovery_stable_updates",
    "scoreSeverity": "score_severity",
    "shockUntilMs": "shock_until_ms",
    "staleBookmakerFractionPpm": "stale_bookmaker_fraction_ppm",
    "unreactedBookmakerCount": "unreacted_bookmaker_count",
}
# ----------------------------------------------------------------------------------------


def decision_json(thresholds: str) -> str:
    """Canonical JSON of a decision row; ``thresholds`` is an expression giving the policy's JSON."""
    fields = {name: cj.text(c) for name, c in _DECISION_TEXT.items()}
    fields["idempotencyKey"] = cj.text("idempotency_key")
    fields["expectedStateVersion"] = cj.scalar("expected_state_version")
    fields["logicalTimestampMs"] = cj.scalar("logical_timestamp_ms")
    fields["evidenceEventIds"] = cj.items("evidence_event_ids", "e", cj.text("e"))
    fields["reasonCodes"] = cj.items("reason_codes", "r", cj.text("r"))
    fields["metrics"] = cj.obj({k: cj.scalar(f"metrics.{c}") for k, c in _METRIC_JSON.items()})
    fields["payloadVersion"] = "'2'"
    fields["thresholds"] = thresholds
    return cj.obj(fields)


def with_decision_hash(decisions: DataFrame, policies: dict) -> DataFrame:
    """Add the canonical payload and its hash; thresholds come from the policies by id."""
    arms = " ".join(
        f"WHEN policy_id = {cj.literal(label)} THEN {cj.literal(canonical_text(p.as_json()))}" for label, p in policies.items()
    )
    payload = decisions.withColumn("decision_json", F.expr(decision_json(f"CASE {arms} END")))
    return payload.withColumn("decision_hash", F.sha2("decision_json", 256))


def decision_conflicts(decisions: DataFrame) -> DataFrame:
    """Decision keys appended with different canonical payloads."""
    return key_conflicts(decisions, "idempotency_key", "decision_hash")


def version_breaks(decisions: DataFrame) -> DataFrame:
    """Decisions that do not continue their predecessor's (state, version), or do not start at OPEN@0.

    Versions are dense, so the predecessor is an equi-join on (market, policy, version - 1)
    and no window has to hold the whole history of a market.
    """
    keys = ["market_id", "policy_id"]
    before = decisions.select(
        *keys, (F.col("expected_state_version") + 1).alias("expected_state_version"), F.col("next_state").alias("expected_state")
    )
    joined = decisions.join(before, [*keys, "expected_state_version"], "left")
    start = F.col("expected_state_version") == 0
    wanted = F.when(start, F.lit("OPEN")).otherwise(F.col("expected_state"))
    return joined.filter(wanted.isNull() | (F.col("previous_state") != wanted)).select(
        "decision_id", *keys, "expected_state_version", "previous_state", wanted.alias("expected_state")
    )


def dedup_stream(records: DataFrame, key: str = "raw_key", delay: str = "10 minutes") -> DataFrame:
    """Streaming dedup with state bounded by a watermark on the source time."""
    timed = records.withColumn("event_time", F.timestamp_millis("source_timestamp_ms"))
    return timed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark([key])
