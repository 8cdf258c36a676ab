"""Read views: joins, filters and top-k lists over the derived tables.

Filters are added only when asked for, so Catalyst sees plain predicates to push down; every
list ends in orderBy + limit, which plans as one TakeOrderedAndProject.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.consensus import consensus_at, quote_vectors
from tidemark.config import ConsensusConfig
from tidemark.schemas import ORDER_FIELDS, event_order


def _where(df: DataFrame, **equal) -> DataFrame:
    for column, value in equal.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def _top(df: DataFrame, order: list[Column], n: int | None) -> DataFrame:
    return df if n is None else df.orderBy(*order).limit(n)


def overview(fixtures: DataFrame, decisions: DataFrame, orders: DataFrame, receipts: DataFrame, runs: DataFrame) -> DataFrame:
    """Counts of five tables and the ids of the latest decision and order, as one row."""
    def counted(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("string").alias("latest")).withColumn("name", F.lit(name))

    def newest(name: str, df: DataFrame, time: str, key: str) -> DataFrame:
        last = F.max(F.struct(time, key))[key]
        return df.agg(F.count(F.lit(1)).alias("n"), last.alias("latest")).withColumn("name", F.lit(name))

    parts = [
        counted("fixtures", fixtures),
        newest("decisions", decisions, "logical_timestamp_ms", "decision_id"),
        newest("orders", orders, "created_at_ms", "order_id"),
        counted("pending_proofs", receipts.filter("status = 'pending'")),
        counted("replay_runs", runs),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    pick = lambda name, value: F.max(F.when(F.col("name") == name, F.col(value)))
    names = ("fixtures", "decisions", "orders", "pending_proofs", "replay_runs")
    return rows.agg(
        *[pick(n, "n").alias(n) for n in names],
        pick("decisions", "latest").alias("latest_decision_id"),
        pick("orders", "latest").alias("latest_order_id"),
    )


def fixtures_view(fixtures: DataFrame, scores: DataFrame, status: str | None = None, n: int | None = 100) -> DataFrame:
    """Fixtures with their latest score, by scheduled time."""
    score = scores.select(
        "fixture_id", "action", "home_score", "away_score", "period", "confirmed",
        F.col("source_timestamp_ms").alias("score_timestamp_ms"),
    )
    joined = _where(fixtures, status=status).join(score, "fixture_id", "left").select(
        "fixture_id", "competition_id", "competition", "participants", "scheduled_at_ms", "status",
        F.col("source_timestamp_ms").alias("updated_at_ms"), "action", "home_score", "away_score", "period", "confirmed",
        "score_timestamp_ms",
    )
    return _top(joined, [F.asc("scheduled_at_ms"), F.asc("fixture_id")], n)


def markets_view(
    markets: DataFrame, control: DataFrame, snapshots: DataFrame, fixture_id: str | None = None, n: int | None = 100
) -> DataFrame:
    """Markets with control state and consensus, newest first; one join instead of a query per market."""
    state = control.select(
        "market_id", "state", "state_version", "last_decision_id", F.col("logical_timestamp_ms").alias("state_at_ms")
    )
    consensus = snapshots.select(
        "market_id", "consensus_id", F.col("status").alias("consensus_status"), "valid_bookmaker_count", "stale_ppm", "outcomes"
    )
    joined = (
        _where(markets, fixture_id=fixture_id)
        .withColumnRenamed("source_timestamp_ms", "updated_at_ms")
        .join(state, "market_id", "left")
        .join(consensus, "market_id", "left")
    )
    return _top(joined, [F.desc("updated_at_ms"), F.asc("market_id")], n)


def fixture_detail(
    fixture_id: str, fixtures: DataFrame, scores: DataFrame, markets: DataFrame, control: DataFrame, snapshots: DataFrame
) -> DataFrame:
    """One fixture with all its markets, one row per market."""
    head = fixtures_view(_where(fixtures, fixture_id=fixture_id), scores, n=None)
    listed = markets_view(markets, control, snapshots, fixture_id, n=None).select(
        "fixture_id", "market_id", "market_type", F.col("status").alias("market_status"), "state", "state_version",
        "consensus_id", "consensus_status",
    )
    return head.join(listed, "fixture_id", "left")


def consensus_now(events: DataFrame, at_ms: int, config: ConsensusConfig) -> DataFrame:
    return consensus_at(quote_vectors(events), at_ms, config)


def timeline_view(
    scores: DataFrame, decisions: DataFrame, fixture_id: str | None = None, before_ms: int | None = None, n: int | None = 200
) -> DataFrame:
    """Score events and decisions of a fixture, newest first."""
    rows = (
        scores.select("fixture_id", F.col("source_timestamp_ms").alias("at_ms"), F.col("event_id").alias("id"), F.lit("score").alias("kind"), F.col("action").alias("detail"))
        .unionByName(
            decisions.select(
                "fixture_id", F.col("logical_timestamp_ms").alias("at_ms"), F.col("decision_id").alias("id"),
                F.lit("decision").alias("kind"), F.col("next_state").alias("detail"),
            )
        )
    )
    rows = _where(rows, fixture_id=fixture_id)
    if before_ms is not None:
        rows = rows.filter(F.col("at_ms") < before_ms)
    return _top(rows, [F.desc("at_ms"), F.desc("id")], n)


def decisions_view(decisions: DataFrame, fixture_id: str | None = None, market_id: str | None = None, n: int | None = 100) -> DataFrame:
    rows = _where(decisions, fixture_id=fixture_id, market_id=market_id)
    return _top(rows, [F.desc("logical_timestamp_ms"), F.desc("decision_id")], n)


def receipts_view(receipts: DataFrame, decisions: DataFrame, fixture_id: str | None = None, status: str | None = None, n: int | None = 100) -> DataFrame:
    times = _where(decisions, fixture_id=fixture_id).select("decision_id", "logical_timestamp_ms")
    joined = _where(receipts, status=status).join(times, "decision_id")
    return _top(joined, [F.desc("logical_timestamp_ms"), F.desc("receipt_id")], n)


def orders_view(orders: DataFrame, fixture_id: str | None = None, namespace: str | None = None, status: str | None = None, n: int | None = 100) -> DataFrame:
    rows = _where(orders, fixture_id=fixture_id, namespace=namespace, status=status)
    return _top(rows, [F.desc("created_at_ms"), F.desc("order_id")], n)


def runs_view(runs: DataFrame, n: int | None = 100) -> DataFrame:
    return _top(runs, [F.desc("started_at_ms"), F.desc("run_id")], n)


def event_page(events: DataFrame, fixture_id: str, n: int, after_event_id: str | None = None) -> tuple[DataFrame, str | None]:
    """Keyset page of a fixture's events and the cursor of the next page.

    Reading a page of ``n`` rows to the driver is the point of the operator; an unknown
    cursor is an error.
    """
    own = events.filter(F.col("fixture_id") == fixture_id)
    rows = own
    if after_event_id is not None:
        cursor = own.filter(F.col("event_id") == after_event_id).select(*ORDER_FIELDS).head()
        if cursor is None:
            raise ValueError(f"unknown cursor {after_event_id!r}")
        here = F.struct(*[F.lit(cursor[f]).cast(dict(own.dtypes)[f]).alias(f) for f in ORDER_FIELDS])
        rows = own.filter(event_order() > here)
    ids = [r.event_id for r in rows.select(*ORDER_FIELDS).orderBy(*ORDER_FIELDS).limit(n + 1).collect()]
    page = rows.orderBy(*ORDER_FIELDS).limit(n)
    return page, (ids[n - 1] if len(ids) > n else None)


def market_maxima(snapshots: DataFrame) -> DataFrame:
    """Largest dispersion and absolute velocity per market, never below zero."""
    velocity = F.array_max(F.transform("outcomes", lambda o: F.abs(o["velocity_micros_per_s"])))
    dispersion = F.array_max(F.transform("outcomes", lambda o: o["dispersion_micros"]))
    return snapshots.groupBy("market_id").agg(
        F.coalesce(F.max(dispersion), F.lit(0)).alias("max_dispersion_micros"),
        F.coalesce(F.max(velocity), F.lit(0)).alias("max_velocity_micros_per_s"),
    )
