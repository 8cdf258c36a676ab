"""Latest-state tables: aggregates with map-side combine over the event order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import FeedLabels
from tidemark.schemas import ORDER_FIELDS, event_order


def live_only(events: DataFrame, labels: FeedLabels = FeedLabels()) -> DataFrame:
    """Only live and snapshot sources may move the operational tables."""
    return events.filter(F.col("source").isin(labels.live, labels.snapshot))


def _latest(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    newest = F.max_by(F.struct(*columns), event_order()).alias("r")
    return df.groupBy(key).agg(newest).select(key, "r.*")


_STAMPS = ["event_id", "source_timestamp_ms", "received_at_ms", "sequence", "source"]


def latest_fixtures(events: DataFrame) -> DataFrame:
    rows = events.filter("kind = 'fixture.observed'").select(
        *dict.fromkeys([*_STAMPS, *ORDER_FIELDS]), "fixture_id",
        "fixture.competition", "fixture.competition_id", "fixture.participants", "fixture.scheduled_at_ms", "fixture.status",
    )
    fields = ["competition", "competition_id", "participants", "scheduled_at_ms", "status"]
    return _latest(rows, "fixture_id", [*fields, *_STAMPS])


def latest_markets(events: DataFrame) -> DataFrame:
    market = F.col("odds.market")
    rows = events.filter("kind = 'odds.observed'").select(
        *dict.fromkeys([*_STAMPS, *ORDER_FIELDS]),
        "fixture_id",
        market["market_id"].alias("market_id"),
        market["type"].alias("market_type"),
        market["period"].alias("period"),
        market["parameters"].alias("parameters"),
        market["game_state"].alias("game_state"),
        market["in_running"].alias("in_running"),
        market["status"].alias("status"),
    )
    fields = ["fixture_id", "market_type", "period", "parameters", "game_state", "in_running", "status"]
    return _latest(rows, "market_id", [*fields, *_STAMPS])


def quotes(events: DataFrame) -> DataFrame:
    """Quote observations in long form, one row per (event, outcome)."""
    rows = events.filter("kind = 'odds.observed'").select(
        "event_id",
        "fixture_id",
        F.col("odds.market.market_id").alias("market_id"),
        F.col("odds.bookmaker.id").alias("bookmaker_id"),
        F.col("odds.bookmaker.name").alias("bookmaker_name"),
        "source",
        "source_id",
        "source_timestamp_ms",
        "received_at_ms",
        "sequence",
        "source_priority",
        F.explode("odds.outcomes").alias("o"),
    )
    return rows.select(
        "*", F.col("o.outcome_id").alias("outcome_id"), F.col("o.name").alias("outcome_name"), F.col("o.price").alias("price"),
        F.col("o.reported_probability_micros").alias("reported_probability_micros"),
    ).drop("o")


def score_events(events: DataFrame) -> DataFrame:
    """Score history."""
    return events.filter("kind = 'score.observed'").select(
        "event_id", "fixture_id", "source", "source_id", "source_timestamp_ms", "received_at_ms", "sequence", "payload_version",
        "score.action", "score.action_id", "score.status_id", "score.period", "score.home_score", "score.away_score",
        "score.confirmed", "score.stats", "score.details",
    )


def latest_scores(events: DataFrame) -> DataFrame:
    rows = events.filter("kind = 'score.observed'").select(
        *dict.fromkeys([*_STAMPS, *ORDER_FIELDS]), "fixture_id", "score.action", "score.action_id", "score.home_score",
        "score.away_score", "score.period", "score.status_id", "score.confirmed",
    )
    fields = ["action", "action_id", "home_score", "away_score", "period", "status_id", "confirmed"]
    return _latest(rows, "fixture_id", [*fields, *_STAMPS])


def market_state(decisions: DataFrame) -> DataFrame:
    """Control state per market: its last committed decision."""
    last = F.max_by(
        F.struct("fixture_id", "next_state", "expected_state_version", "decision_id", "logical_timestamp_ms"),
        "expected_state_version",
    )
    return decisions.groupBy("market_id").agg(last.alias("d")).select(
        "market_id",
        "d.fixture_id",
        F.col("d.next_state").alias("state"),
        (F.col("d.expected_state_version") + 1).alias("state_version"),
        F.col("d.decision_id").alias("last_decision_id"),
        "d.logical_timestamp_ms",
    )
