"""Table schemas and the event order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OUTCOME_DDL = "ARRAY<STRUCT<name: STRING, outcome_id: STRING, price: BIGINT, reported_probability_micros: BIGINT>>"
FIXTURE_DDL = (
    "STRUCT<fixture_id: STRING, competition: STRING, competition_id: STRING, "
    "participants: ARRAY<STRUCT<id: STRING, name: STRING, role: STRING>>, scheduled_at_ms: BIGINT, status: STRING>"
)
ODDS_DDL = (
    "STRUCT<fixture_id: STRING, bookmaker: STRUCT<id: STRING, name: STRING>, "
    "market: STRUCT<game_state: STRING, in_running: BOOLEAN, market_id: STRING, parameters: STRING, "
    "period: STRING, status: STRING, type: STRING>, "
    f"outcomes: {OUTCOME_DDL}>"
)
DETAILS_DDL = (
    "STRUCT<amended_action: STRING, outcome: STRING, "
    "possible: STRUCT<goal: BOOLEAN, penalty: BOOLEAN, red_card: BOOLEAN, review: BOOLEAN>, "
    "referenced_action_id: STRING, reliable: BOOLEAN, review_type: STRING>"
)
SCORE_DDL = (
    "STRUCT<fixture_id: STRING, action: STRING, away_score: BIGINT, home_score: BIGINT, period: BIGINT, "
    "stats: ARRAY<STRUCT<key: BIGINT, period: BIGINT, value: BIGINT>>, status_id: BIGINT, "
    f"action_id: STRING, confirmed: BOOLEAN, details: {DETAILS_DDL}>"
)
EVENTS_DDL = (
    "event_id STRING, idempotency_key STRING, fixture_id STRING, kind STRING, payload_version INT, "
    "source STRING, source_id STRING, source_priority INT, source_timestamp_ms BIGINT, "
    f"received_at_ms BIGINT, sequence BIGINT, fixture {FIXTURE_DDL}, odds {ODDS_DDL}, score {SCORE_DDL}"
)
RAW_INPUT_DDL = (
    "payload_kind STRING, payload_version INT, source STRING, received_at_ms BIGINT, "
    "sequence BIGINT, payload STRING"
)
ORDER_REQUEST_DDL = (
    "expected_decision_id STRING, expected_state_version BIGINT, fixture_id STRING, idempotency_key STRING, "
    "market_id STRING, namespace STRING, outcome_id STRING, price BIGINT, quote_observed_at_ms BIGINT, "
    "requested_at_ms BIGINT, side STRING, stake_micros BIGINT"
)
RUNS_DDL = (
    "run_id STRING, manifest_id STRING, namespace STRING, input_fixture_id STRING, input_hash STRING, "
    "config_hash STRING, speed STRING, status STRING, started_at_ms BIGINT, completed_at_ms BIGINT, "
    "event_count BIGINT, last_event_id STRING"
)

ORDER_FIELDS = (
    "source_timestamp_ms",
    "sequence",
    "source_priority",
    "source_id",
    "idempotency_key",
    "event_id",
)


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def event_order(prefix: str = "") -> Column:
    """The total order of events as one comparable struct."""
    return F.struct(*[F.col(prefix + f).alias(f) for f in ORDER_FIELDS])
