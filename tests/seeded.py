"""The eight-event scenario with a known answer: one market, one bookmaker, one goal signal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import canonical as cj
from tidemark.schemas import EVENTS_DDL, schema

T0 = 1_784_311_200_000
FIXTURE = "seeded-world-cup-canada-japan"
COMPETITION_ID = "seeded-world-cup-2026"

# source id, seconds after T0, probabilities in thousandths, prices
ODDS = (
    ("seed-odds-1", 1, (400, 320, 280), (2400, 3100, 2800)),
    ("seed-odds-stale", 63, (400, 320, 280), (2400, 3100, 2800)),
    ("seed-odds-caught-up", 68, (600, 250, 150), (1650, 3600, 5100)),
    ("seed-odds-recovery-1", 72, (600, 250, 150), (1650, 3600, 5100)),
    ("seed-odds-recovery-2", 75, (600, 250, 150), (1650, 3600, 5100)),
    ("seed-odds-recovery-3", 78, (600, 250, 150), (1650, 3600, 5100)),
)
OUTCOMES = (("Canada", "seeded-canada"), ("Draw", "seeded-draw"), ("Japan", "seeded-japan"))


def seeded_events(
    spark: SparkSession, book_name: str = "Consensus (seeded)", competition: str = "World Cup (seeded demo)"
) -> DataFrame:
    market = spark.sql(
        "SELECT "
        + cj.market_id(
            f"'{FIXTURE}'", "true", "array('Canada', 'Draw', 'Japan')", "cast(null as string)", "'full_time'", "'1X2'"
        )
    ).head()[0]

    def envelope(source_id, kind, version, second, sequence):
        at = T0 + second * 1000
        return [None, None, FIXTURE, kind, version, "simulation", source_id, 0, at, at, sequence]

    sides = [("can", "Canada", "home"), ("jpn", "Japan", "away")]
    fixture = (FIXTURE, competition, COMPETITION_ID, sides, T0, "live")
    rows = [(*envelope("seed-fixture-v1", "fixture.observed", 1, 0, 0), fixture, None, None)]
    details = (None, None, (True, False, False, False), None, None, None)
    stats = [(1, 0, 1), (2, 0, 0)]
    goal = (FIXTURE, "goal", 0, 1, 2, stats, 2, "seed-action-goal-1", False, details)
    rows.append((*envelope("seed-score-1", "score.observed", 2, 60, 2), None, None, goal))
    for position, (source_id, second, thousandths, prices) in enumerate(ODDS):
        outcomes = [(n, i, p, m * 1000) for (n, i), p, m in zip(OUTCOMES, prices, thousandths)]
        quoted = (
            FIXTURE,
            ("consensus", book_name),
            ("in_play", True, market, None, "full_time", "open", "1X2"),
            outcomes,
        )
        sequence = 1 if position == 0 else position + 2
        rows.append((*envelope(source_id, "odds.observed", 2, second, sequence), None, quoted, None))
    raw = spark.createDataFrame(rows, schema(EVENTS_DDL))
    keyed = raw.withColumn("idempotency_key", F.expr(cj.event_key("source", "kind", "source_id", "payload_version")))
    return keyed.withColumn("event_id", F.expr(cj.event_id("idempotency_key")))


def seeded_fixtures(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(FIXTURE, COMPETITION_ID, T0, T0, T0 + 78_000, "[]")],
        "fixture_id string, competition_id string, scheduled_at_ms long, source_start_ms long, "
        "source_end_ms long, intervals_json string",
    )
