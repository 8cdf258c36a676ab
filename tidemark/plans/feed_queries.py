"""Named queries over the sample feed: every operator applied to the given tables.

Results hold integers and text only, so they compare exactly with plain SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import EvaluationConfig, FeedLabels, MarketSelection, ReplayConfig
from tidemark.functions.staging import ensure_checkpoint_dir, stage
from tidemark.operators import consensus as con
from tidemark.operators import dedup, evaluation, ops, orders, projections, provenance, receipts, risk, views
from tidemark.operators import normalize as norm
from tidemark.operators.classify import classify_scores
from tidemark.sources import raw as raw_source
from tidemark.sources import sample_feed as feed
from tidemark.sources import tables as stored

NOW_MS = 1_706_659_200_000  # 2024-01-31, just after the feed's month
MID_MS = 1_705_276_800_000  # 2024-01-15
HALF_DAY_MS = 43_200_000
POLICIES = {
    "base": feed.POLICY,
    "short_hold": feed.POLICY.but(critical_shock_hold_ms=6_912_000),
    "slow_reopen": feed.POLICY.but(recovery_stable_updates=4),
}
EVALUATION = EvaluationConfig(
    convergence_tolerance_micros=60_000,
    convergence_window_ms=21_600_000,
    material_move_threshold_micros=30_000,
    overlong_pause_grace_ms=3_600_000,
)
REACTION_THRESHOLD = 20_000
REPLAY = ReplayConfig(strategy=feed.POLICY.as_json())
LABELS = FeedLabels()


class FeedTables:
    """Tables derived from one data directory; each is computed once per session."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def events(self) -> DataFrame:
        return feed.events(self.spark, self.sf_dir)

    @cached_property
    def quotes(self) -> DataFrame:
        return con.quote_vectors(self.events)

    @cached_property
    def trace(self) -> DataFrame:
        """The consensus trace; an id is computed where it is read."""
        observed = stage(con.consensus_observations(self.events, feed.CONSENSUS))
        return con.identify_snapshots(observed, feed.CONSENSUS, "snapshot_t")

    @property
    def observations(self) -> DataFrame:
        """The trace for a step that reads its features once: unless stored already, only what they need is computed."""
        stored = self.__dict__.get("trace")
        return con.consensus_observations(self.events, feed.CONSENSUS, provenance=False) if stored is None else stored

    @cached_property
    def inputs(self) -> DataFrame:
        return risk.risk_inputs(self.events, self.observations, feed.CONSENSUS)

    def keep_events(self) -> None:
        """Store the events, for a query that reads them many times."""
        self.__dict__.setdefault("kept_events", None)
        if self.kept_events is None:
            self.kept_events = self.events = stage(self.events)

    @cached_property
    def aged_inputs(self) -> DataFrame:
        return risk.risk_inputs(self.events, self.trace, feed.CONSENSUS, feature_time="event")

    @cached_property
    def sweep_decisions(self) -> DataFrame:
        return stage(risk.decide(self.inputs, POLICIES))

    @property
    def sweep_rows(self) -> DataFrame:
        """The sweep's decisions for a query that reads them once: unless stored already, only what it needs is computed."""
        stored = self.__dict__.get("sweep_decisions")
        return risk.decide(self.inputs, POLICIES) if stored is None else stored

    @cached_property
    def sweep_states(self) -> DataFrame:
        """The sweep's decisions without hashed inputs, reasons and metrics, which no evaluation reads."""
        return self.sweep_decisions if "sweep_decisions" in self.__dict__ else stage(self.sweep_rows.select(*evaluation.DECISION_COLUMNS))

    @cached_property
    def decisions(self) -> DataFrame:
        return stage(risk.decide(self.inputs, {"base": feed.POLICY}))

    @cached_property
    def hashed_decisions(self) -> DataFrame:
        return dedup.with_decision_hash(self.decisions, {"base": feed.POLICY})

    @cached_property
    def normalized(self) -> DataFrame:
        return stage(norm.normalize(feed.raw_feed(self.spark, self.sf_dir)))

    @property
    def records(self) -> DataFrame:
        """`normalized` for a query that reads it once: unless stored already, only what it needs is computed."""
        stored = self.__dict__.get("normalized")
        return norm.normalize(feed.raw_feed(self.spark, self.sf_dir)) if stored is None else stored

    @cached_property
    def labelled(self) -> DataFrame:
        return stage(dedup.label_arrivals(self.normalized))

    @cached_property
    def labelled_identities(self) -> DataFrame:
        """`labelled` without the payloads, for queries that read identities alone."""
        if "labelled" in self.__dict__:
            return self.labelled
        return stage(dedup.label_arrivals(stage(self.records.drop(*norm.PAYLOADS))))

    @cached_property
    def fixture_events(self) -> DataFrame:
        return stage(norm.accepted_events(norm.normalize(feed.raw_fixtures(self.spark, self.sf_dir))))

    @cached_property
    def latest_fixtures(self) -> DataFrame:
        return projections.latest_fixtures(self.fixture_events)

    @property
    def fixture_rows(self) -> DataFrame:
        """`latest_fixtures` for a query that reads them once: unless stored already, only what it needs is computed."""
        if "fixture_events" in self.__dict__:
            return self.latest_fixtures
        return projections.latest_fixtures(norm.accepted_events(norm.normalize(feed.raw_fixtures(self.spark, self.sf_dir))))

    @cached_property
    def receipts(self) -> DataFrame:
        return stage(self._receipts())

    def _receipts(self) -> DataFrame:
        found, _ = receipts.receipt_evidence(self.decisions, self.events)
        return receipts.receipts(self.decisions, found, {"base": feed.POLICY})

    @cached_property
    def receipt_heads(self) -> DataFrame:
        """Receipts without the hashed documents."""
        return self.receipts if "receipts" in self.__dict__ else stage(self._receipts().drop("decision_json", "evidence", *receipts.HASHED))

    @cached_property
    def order_requests(self) -> DataFrame:
        return orders.order_ids(feed.order_requests(self.spark, self.sf_dir, self.decisions))

    @cached_property
    def orders(self) -> DataFrame:
        admission = orders.admit(orders.orders_asof(self.order_requests, self.decisions), receipts=self.receipt_heads)
        return stage(admission)

    @cached_property
    def snapshot(self) -> DataFrame:
        return con.consensus_at(self.quotes, MID_MS, feed.CONSENSUS, ignore_later=True)

    @cached_property
    def signals(self) -> DataFrame:
        return stage(evaluation.signals(self.events))

    @cached_property
    def baseline(self) -> DataFrame:
        return stage(evaluation.baseline(self.trace, self.signals))

    @cached_property
    def anchor_signals(self) -> DataFrame:
        """A later anchor per fixture, so that a baseline exists: the last pausing signal before mid-month."""
        pausing = classify_scores(self.events).filter("protective_action = 'pause'")
        scored = pausing.filter(F.col("source_timestamp_ms") < MID_MS)
        last = F.max_by(
            F.struct("event_id", "source_timestamp_ms", "kind", "confirmation"), F.struct("source_timestamp_ms", "event_id")
        )
        rows = scored.groupBy("fixture_id").agg(last.alias("s"))
        return stage(
            rows.select(
                "fixture_id",
                F.col("s.event_id").alias("signal_event_id"),
                F.col("s.source_timestamp_ms").alias("signal_t"),
                F.col("s.kind").alias("signal_kind"),
                F.col("s.confirmation").alias("signal_confirmation"),
            )
        )

    @cached_property
    def anchor_baseline(self) -> DataFrame:
        return stage(evaluation.baseline(self.trace, self.anchor_signals))

    @cached_property
    def selections(self) -> DataFrame:
        """One replay selection per fixture: from its first event to the middle of the month."""
        first = self.events.groupBy("fixture_id").agg(F.min("source_timestamp_ms").alias("source_start_ms"))
        return first.withColumn("source_end_ms", F.lit(MID_MS))

    @cached_property
    def manifest_rows(self) -> DataFrame:
        spans = self.events.groupBy("fixture_id").agg(
            F.min("source_timestamp_ms").alias("source_start_ms"), F.max("source_timestamp_ms").alias("source_end_ms")
        )
        described = spans.select(
            "fixture_id",
            F.lit("0").alias("competition_id"),
            F.col("source_start_ms").alias("scheduled_at_ms"),
            "source_start_ms",
            "source_end_ms",
            F.lit("[]").alias("intervals_json"),
        )
        return stage(provenance.manifests(self.events, described, REPLAY))

    @cached_property
    def facts(self) -> DataFrame:
        probes = self.probes
        return stage(evaluation.report_facts(self.events, self.trace, self.sweep_states, EVALUATION, probes))

    @cached_property
    def probes(self) -> DataFrame:
        self.keep_events()
        _ = self.trace  # the inputs of the decisions read it too
        return stage(evaluation.probe_orders(self.events, self.sweep_states, self.signals))

    @cached_property
    def reports(self) -> DataFrame:
        changes = {"short_hold": {"criticalShockHoldMs": 6_912_000}, "slow_reopen": {"recoveryStableUpdates": 4}}
        probes = self.probes
        return stage(
            evaluation.evaluate(
                self.events, self.trace, self.sweep_states, self.manifest_rows, POLICIES, EVALUATION, probes, "base", changes
            )
        )

    @cached_property
    def runs(self) -> DataFrame:
        """A replay run log derived from `orders`: one run per order, some left open."""
        source = self.spark.read.parquet(f"{self.sf_dir}/orders.parquet")
        status = F.element_at(
            F.array(*[F.lit(s) for s in ("pending", "running", "paused", "completed", "stopped", "failed")]),
            (F.col("o_orderkey") % 6 + 1).cast("int"),
        )
        started = F.unix_millis(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey")
        return source.select(
            F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("run_id"),
            F.concat(F.lit("manifest-"), (F.col("o_custkey") % 12).cast("string")).alias("manifest_id"),
            F.concat(F.lit("replay:run-"), F.col("o_orderkey").cast("string")).alias("namespace"),
            status.alias("status"),
            started.alias("started_at_ms"),
            F.when(status.isin("completed", "stopped", "failed"), started + 60_000).alias("completed_at_ms"),
            (F.col("o_orderkey") % 100).alias("event_count"),
        )

    @cached_property
    def requests(self) -> DataFrame:
        """A request log derived from `lineitem`."""
        lines = self.spark.read.parquet(f"{self.sf_dir}/lineitem.parquet")
        return lines.select(
            F.when(F.col("l_linenumber") == 7, F.lit(503)).when(F.col("l_linenumber") == 6, F.lit(404)).otherwise(F.lit(200)).alias("status_code"),
            ((F.col("l_orderkey") * 7919 + F.col("l_partkey")) % 997).alias("duration_ms"),
        )


_TABLES: dict[tuple[str, str], FeedTables] = {}


def tables(spark: SparkSession, sf_dir: str) -> FeedTables:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TABLES:
        _TABLES[key] = FeedTables(spark, sf_dir)
    return _TABLES[key]


def forget() -> None:
    """Drop what has been computed, so that the next query starts from the input files."""
    _TABLES.clear()


# --- sources -------------------------------------------------------------------------


def feed_messages(t: FeedTables) -> DataFrame:
    n = F.col("arrival") % 9
    source = feed.raw_feed(t.spark, t.sf_dir)
    data = (
        F.when(n == 1, F.lit("  Ping "))
        .when(n == 2, F.concat(F.lit("["), F.col("payload"), F.lit(","), F.col("payload"), F.lit("]")))
        .when(n == 3, F.concat(F.lit("not json "), F.col("arrival").cast("string")))
        .otherwise(F.col("payload"))
    )
    event = F.when(n == 0, F.lit("HeartBeat")).otherwise(F.lit("message"))
    return raw_source.explode_messages(source.select("arrival", "payload_kind", event.alias("event"), data.alias("data")))


def bucket_coordinates(t: FeedTables) -> DataFrame:
    rows = feed.base(t.spark, t.sf_dir).select("n", "t")
    return rows.select("n", *[c.alias(k) for k, c in raw_source.bucket_cols(F.col("t")).items()])


def planned_buckets(t: FeedTables) -> DataFrame:
    plan = raw_source.plan_selection_buckets(t.selections)
    return plan.groupBy("fixture_id", "valid").agg(
        F.count(F.lit(1)).alias("buckets"), F.min("bucket_start_ms").alias("first_ms"), F.max("bucket_end_ms").alias("last_ms")
    )


def source_range(t: FeedTables) -> DataFrame:
    rows = raw_source.in_source_range(
        feed.raw_feed(t.spark, t.sf_dir).select("arrival", "payload"), F.lit(1_704_844_800_000), F.lit(MID_MS)
    )
    return rows.select("arrival", "source_time_ms")


def _hydrate(t: FeedTables):
    raw = feed.raw_feed(t.spark, t.sf_dir).withColumn("fixture_id", F.get_json_object("payload", "$.FixtureId"))
    raw = raw.withColumn("fixture_id", F.coalesce("fixture_id", F.get_json_object("payload", "$.fixtureId")))
    scores = raw.filter("payload_kind = 'score'")
    odds = raw.filter("payload_kind = 'odds'").select("fixture_id", "arrival", "payload", "received_at_ms")
    # records of fixture 1 filed under fixture 2, a selection from the epoch on, and a reversed one
    moved = lambda df: df.withColumn("fixture_id", F.when(F.col("fixture_id") == "1", F.lit("2")).otherwise(F.col("fixture_id")))
    start = F.when(F.col("fixture_id") == "3", F.lit(0)).when(F.col("fixture_id") == "4", F.lit(MID_MS + 1)).otherwise(F.col("source_start_ms"))
    selections = t.selections.filter("fixture_id <> '1'").withColumn("source_start_ms", start)
    path = f"{ensure_checkpoint_dir(t.spark)}/backfill-{uuid.uuid4().hex}"
    raw_source.write_backfill(moved(odds), path, F.col("received_at_ms"), folders=("epoch_day",))  # a sparse feed
    return raw_source.hydrate(moved(scores), raw_source.read_backfill(t.spark, path, selections), selections, LABELS, NOW_MS)


def hydration_events(t: FeedTables) -> DataFrame:
    events, _, _ = _hydrate(t)
    return events.select("event_id", "fixture_id", "kind", "source", "source_timestamp_ms", "sequence")


def hydration_counts(t: FeedTables) -> DataFrame:
    _, _, summary = _hydrate(t)
    return summary


def append_conflicts(t: FeedTables) -> DataFrame:
    """Records that re-use a key with another payload, as two appends set them aside."""
    path = f"{ensure_checkpoint_dir(t.spark)}/appends-{uuid.uuid4().hex}"
    for part in ("arrival % 3 = 0", "arrival % 3 <> 0"):
        stored.write_raw(t.normalized.filter(part), path, layout=stored.Layout(key_buckets=1))
    return t.spark.read.parquet(f"{path}_conflicts").select("idempotency_key", "source_id", "raw_payload_hash", "status")


# --- normalization -------------------------------------------------------------------


def normalized_odds(t: FeedTables) -> DataFrame:
    good = t.normalized.filter("payload_kind = 'odds' AND quarantine_code IS NULL")
    rows = good.select("arrival", "event_id", "fixture_id", "odds", F.explode("odds.outcomes").alias("o"))
    return rows.select(
        "arrival", "event_id", "fixture_id", F.col("odds.market.market_id").alias("market_id"),
        F.col("odds.market.status").alias("market_status"), F.col("odds.bookmaker.id").alias("bookmaker_id"),
        F.col("o.outcome_id").alias("outcome_id"), F.col("o.price").alias("price"),
        F.col("o.reported_probability_micros").alias("reported_micros"),
    )


def normalized_scores(t: FeedTables) -> DataFrame:
    good = t.normalized.filter("payload_kind = 'score' AND quarantine_code IS NULL")
    return good.selectExpr(
        "arrival", "event_id", "fixture_id", "source_id", "event_sequence AS sequence", "score.action", "score.action_id",
        "score.home_score", "score.away_score", "score.status_id", "cast(score.confirmed AS string) AS confirmed",
        "cast(score.details.possible.goal AS string) AS goal", "cast(score.details.possible.penalty AS string) AS penalty",
        "cast(score.details.possible.red_card AS string) AS red_card", "cast(score.details.possible.review AS string) AS review",
        "score.details.outcome", "score.details.referenced_action_id", "cast(score.details.reliable AS string) AS reliable",
        "array_join(transform(score.stats, x -> concat_ws(':', x.key, x.period, x.value)), ',') AS stats",
    )


def normalized_fixtures(t: FeedTables) -> DataFrame:
    return t.fixture_events.selectExpr(
        "event_id", "fixture_id", "source_id", "source_timestamp_ms", "fixture.competition", "fixture.scheduled_at_ms", "fixture.status",
        "fixture.participants[0].name AS home", "fixture.participants[1].id AS away_id",
    )


def quarantine(t: FeedTables) -> DataFrame:
    return norm.quarantined(t.normalized).select(
        "arrival", "ingest_id", "payload_kind", "fixture_id", "source_id", "quarantine_code", "payload_hash",
        F.size("quarantine_issues").alias("issues"),
    )


def raw_identity(t: FeedTables) -> DataFrame:
    return norm.raw_records(t.records).select(
        "ingest_id", "source_id", "payload_kind", "source_timestamp_ms", "status", "raw_payload_hash"
    )


def odds_issue_counts(t: FeedTables) -> DataFrame:
    odds = feed.raw_feed(t.spark, t.sf_dir).filter("payload_kind = 'odds'")
    issues = norm.odds_issues(odds).select(F.explode("issues").alias("issue"))
    return issues.groupBy("issue").agg(F.count(F.lit(1)).alias("records"))


def _number() -> Column:
    """The row number of an event in the feed, the last part of its source id."""
    return F.element_at(F.split("source_id", ":"), -1).cast("long")


def envelope_audit(t: FeedTables) -> DataFrame:
    mod = _number() % 40
    bent = t.events.withColumns(
        {
            "source_priority": F.when(mod == 0, F.lit(31)).otherwise(F.col("source_priority")),
            "idempotency_key": F.when(mod == 1, F.lit("event|bad")).otherwise(F.col("idempotency_key")),
            "fixture_id": F.when(mod == 2, F.lit("999")).otherwise(F.col("fixture_id")),
        }
    )
    return norm.envelope_violations(bent).select("event_id", F.array_join("violations", ",").alias("violations"))


def raw_event_audit(t: FeedTables) -> DataFrame:
    inserted = t.labelled_identities.filter("append_status = 'inserted'")
    raw, events = norm.raw_records(inserted), norm.accepted_events(inserted)
    moved = events.withColumn(
        "source_timestamp_ms", F.col("source_timestamp_ms") + F.when(F.col("source_timestamp_ms") % 25 == 0, F.lit(1)).otherwise(F.lit(0))
    )
    return norm.raw_event_mismatches(raw, moved)


def event_shape_audit(t: FeedTables) -> DataFrame:
    odds = F.col("odds").withField("bookmaker.name", F.when(_number() % 30 == 0, F.lit("")).otherwise(F.col("odds.bookmaker.name")))
    score = F.col("score").withField("home_score", F.when(_number() % 30 == 1, F.lit(-1).cast("long")).otherwise(F.col("score.home_score")))
    bent = t.events.withColumns({"odds": F.when(F.col("odds").isNotNull(), odds), "score": F.when(F.col("score").isNotNull(), score)})
    return norm.event_violations(bent).select("event_id", F.array_join("violations", ",").alias("violations"))


def world_cup_fixtures(t: FeedTables) -> DataFrame:
    found = norm.fixtures_in(feed.raw_fixtures(t.spark, t.sf_dir))
    return found.groupBy("fixture_id", "competition", "home", "away").agg(
        F.count(F.lit(1)).alias("observations"), F.min("start_time_ms").alias("first_start_ms")
    )


# --- dedup ---------------------------------------------------------------------------


def append_labels(t: FeedTables) -> DataFrame:
    return t.labelled.select("arrival", "ingest_id", "append_status")


def payload_conflicts(t: FeedTables) -> DataFrame:
    return dedup.raw_conflicts(t.normalized)


def event_key_conflicts(t: FeedTables) -> DataFrame:
    moved = t.normalized.withColumn(
        "raw_key", F.when(F.col("arrival") % 7 == 0, F.concat("raw_key", F.lit("|moved"))).otherwise(F.col("raw_key"))
    )
    return dedup.event_conflicts(moved)


def decision_payload_conflicts(t: FeedTables) -> DataFrame:
    again = t.decisions.filter(F.col("expected_state_version") % 5 == 0)
    changed = again.withColumn(
        "logical_timestamp_ms", F.col("logical_timestamp_ms") + F.when(F.col("expected_state_version") % 10 == 0, F.lit(1)).otherwise(F.lit(0))
    )
    return dedup.decision_conflicts(dedup.with_decision_hash(t.decisions.unionByName(changed), {"base": feed.POLICY}))


def version_audit(t: FeedTables) -> DataFrame:
    bent = t.decisions.withColumn(
        "previous_state", F.when(F.col("expected_state_version") % 50 == 0, F.lit("WIDENED")).otherwise(F.col("previous_state"))
    )
    return dedup.version_breaks(bent).select("market_id", "expected_state_version", "previous_state", "expected_state")


# --- projections ---------------------------------------------------------------------


def latest_fixture_rows(t: FeedTables) -> DataFrame:
    return t.latest_fixtures.selectExpr(
        "fixture_id", "competition", "scheduled_at_ms", "status", "participants[0].name AS home", "event_id", "source_timestamp_ms"
    )


def latest_market_rows(t: FeedTables) -> DataFrame:
    live = projections.live_only(t.events)
    return projections.latest_markets(live).select("market_id", "fixture_id", "market_type", "period", "status", "event_id", "source_timestamp_ms")


def quote_rows(t: FeedTables) -> DataFrame:
    return projections.quotes(t.events).select(
        "event_id", "market_id", "bookmaker_id", "outcome_id", "price", "reported_probability_micros", "source_timestamp_ms"
    )


def score_history(t: FeedTables) -> DataFrame:
    return projections.score_events(t.events).selectExpr(
        "event_id", "fixture_id", "source_timestamp_ms", "action", "status_id", "home_score", "away_score",
        "cast(confirmed AS string) AS confirmed", "details.outcome", "details.review_type",
    )


def latest_score_rows(t: FeedTables) -> DataFrame:
    return projections.latest_scores(projections.live_only(t.events)).selectExpr(
        "fixture_id", "action", "home_score", "away_score", "status_id", "cast(confirmed AS string) AS confirmed", "event_id"
    )


def control_states(t: FeedTables) -> DataFrame:
    return projections.market_state(t.decisions)


# --- consensus -----------------------------------------------------------------------


def normalized_vectors(t: FeedTables) -> DataFrame:
    return con.normalized_outcomes(t.quotes)


def latest_quotes(t: FeedTables) -> DataFrame:
    return con.latest_by_bookmaker(t.quotes.drop("ord")).select("market_id", "bookmaker_id", "event_id", "observed_at_ms")


def quote_freshness(t: FeedTables) -> DataFrame:
    # quotes up to half a day later are known, so all three labels occur
    latest = con.latest_by_bookmaker(t.quotes.drop("ord").filter(F.col("observed_at_ms") <= MID_MS + HALF_DAY_MS))
    return con.freshness(latest, F.lit(MID_MS), feed.CONSENSUS).select("market_id", "bookmaker_id", "event_id", "freshness", "age_ms")


def _snapshot_columns(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(
        *keys, "status", "fresh_bookmaker_count", "valid_bookmaker_count", "stale_bookmaker_count", "total_bookmaker_count",
        "stale_ppm", "freshest_age_ms", "oldest_fresh_age_ms", "consensus_id",
    )


def consensus_trace(t: FeedTables) -> DataFrame:
    return _snapshot_columns(t.trace, "event_id", "market_id", "t")


def consensus_outcomes(t: FeedTables) -> DataFrame:
    return con.snapshot_outcomes(t.trace).select(
        "event_id", "market_id", "outcome_id", "probability_micros", "dispersion_micros", "delta_micros", "velocity_micros_per_s"
    )


def consensus_diagnostics(t: FeedTables) -> DataFrame:
    return con.snapshot_diagnostics(t.trace).select("trigger_event_id", "code", "bookmaker_id", "quote_event_id")


def consensus_at_time(t: FeedTables) -> DataFrame:
    return _snapshot_columns(t.snapshot, "market_id")


def reaction_latencies(t: FeedTables) -> DataFrame:
    anchors = t.baseline.join(t.signals, "fixture_id").select(
        F.col("fixture_id").alias("signal_id"), "market_id", "signal_t", "baseline_status", "baseline_outcomes"
    )
    return con.reaction_latency(anchors, t.quotes, REACTION_THRESHOLD)


def core_markets(t: FeedTables) -> DataFrame:
    markets = projections.latest_markets(t.events).select("market_id", "fixture_id", "market_type", "in_running")
    candidates = t.snapshot.join(markets, "market_id").withColumn("outcome_count", F.size("outcomes"))
    chosen = con.select_core_market(candidates, MarketSelection(2, ("1X2",), True))
    return chosen.select("fixture_id", "market_id", "selection_rank", F.col("selected").cast("int").alias("selected"))


# --- risk ----------------------------------------------------------------------------


def score_classes(t: FeedTables) -> DataFrame:
    return classify_scores(t.events).select(
        "event_id", "action", "kind", "reason_code", "protective_action", "severity", "confirmation"
    )


def snapshot_risk_features(t: FeedTables) -> DataFrame:
    return risk.risk_features(t.trace).select(
        "event_id", "consensus_status", "fresh_bookmaker_count", "max_abs_velocity", "max_dispersion", "oldest_fresh_age_ms", "stale_ppm"
    )


def threshold_reasons(t: FeedTables) -> DataFrame:
    policy = risk.policy_struct(feed.POLICY, "base")
    featured = t.trace.withColumns({"f": risk.snapshot_features(), "p": policy, "proof": F.lit("verified")})
    pause, widen = risk.market_reasons(F.col("f"), F.col("p"), F.col("proof"))
    healthy = risk.recovery_healthy(F.col("f"), F.col("p"), F.col("proof"))
    return featured.select(
        "event_id", F.array_join(pause, ",").alias("pause_reasons"), F.array_join(widen, ",").alias("widen_reasons"), healthy.cast("int").alias("healthy")
    )


def attributed_events(t: FeedTables) -> DataFrame:
    return t.inputs.select("event_id", "market_id", "kind", F.col("features.oldest_fresh_age_ms").alias("oldest_fresh_age_ms"))


def event_time_features(t: FeedTables) -> DataFrame:
    return t.aged_inputs.select("event_id", "market_id", "kind", *[F.col(f"features.{c}").alias(c) for c in (
        "consensus_status", "fresh_bookmaker_count", "max_abs_velocity", "max_dispersion", "oldest_fresh_age_ms", "stale_ppm"
    )])


def event_time_decisions(t: FeedTables) -> DataFrame:
    return _decision_columns(risk.decide(t.aged_inputs, {"base": feed.POLICY}))


def _decision_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "policy_id", "decision_id", "market_id", F.col("trigger_event_id").alias("event_id"), "action", "previous_state", "next_state",
        "expected_state_version", F.array_join("reason_codes", ",").alias("reasons"),
        F.col("metrics.recovery_stable_updates").alias("stable_updates"), F.col("metrics.shock_until_ms").alias("shock_until_ms"),
        F.col("metrics.last_state_change_at_ms").alias("state_change_ms"),
    )


def risk_decisions(t: FeedTables) -> DataFrame:
    return _decision_columns(t.decisions)


def decision_payloads(t: FeedTables) -> DataFrame:
    metrics = [F.col(f"metrics.{c}").alias(c) for c in (
        "active_shock_remaining_ms", "fresh_bookmaker_count", "max_abs_velocity_micros_per_second", "max_dispersion_mad_micros",
        "max_reaction_latency_ms", "oldest_fresh_quote_age_ms", "proof_status", "score_severity", "stale_bookmaker_fraction_ppm",
        "unreacted_bookmaker_count",
    )]
    return t.decisions.select("decision_id", "policy_configuration_hash", "input_feature_hash", *metrics)


def policy_sweep_decisions(t: FeedTables) -> DataFrame:
    return t.sweep_rows.groupBy("policy_id", "market_id", "previous_state", "next_state").agg(F.count(F.lit(1)).alias("decisions"))


def fanned_out_decisions(t: FeedTables) -> DataFrame:
    inputs = risk.risk_inputs(t.events, t.trace, feed.CONSENSUS, fanout="all_markets")
    decided = risk.decide(inputs, {"base": feed.POLICY})
    return decided.groupBy("market_id", "next_state").agg(
        F.count(F.lit(1)).alias("decisions"), F.max("expected_state_version").alias("last_version")
    )


def resumed_decisions(t: FeedTables) -> DataFrame:
    """Second half of the month, folded from the state the first half left behind."""
    state = risk.state_from_decisions(t.decisions.filter(F.col("logical_timestamp_ms") < MID_MS))
    later = t.inputs.filter(F.col("t") >= MID_MS)
    return _decision_columns(risk.decide(later, {"base": feed.POLICY}, initial=state))


def restart_states(t: FeedTables) -> DataFrame:
    return risk.state_from_decisions(t.decisions)


def late_inputs(t: FeedTables) -> DataFrame:
    state = risk.state_from_decisions(t.decisions.filter(F.col("logical_timestamp_ms") < MID_MS))
    return risk.late_inputs(t.inputs, state).select("market_id", "event_id", "t", "last_applied_ms")


def transition_audit(t: FeedTables) -> DataFrame:
    bent = t.decisions.withColumn("action", F.when(F.col("expected_state_version") % 20 == 0, F.lit("reopen")).otherwise(F.col("action")))
    return risk.illegal_transitions(bent).select("decision_id", "action", "previous_state", "next_state")


def namespaced_markets(t: FeedTables) -> DataFrame:
    markets = t.quotes.select("market_id").distinct()
    return markets.select(
        "market_id",
        F.expr(risk.namespace_market("'evaluation:sample'", "market_id")).alias("evaluation_market_id"),
        F.expr(risk.replay_resource("'run-1'", "market_id")).alias("replay_market_id"),
    )


# --- orders --------------------------------------------------------------------------


def order_audit(t: FeedTables) -> DataFrame:
    bent = t.order_requests.withColumns(
        {
            "stake_micros": F.when(F.col("price") % 20 == 0, F.lit(0)).otherwise(F.col("stake_micros")),
            "namespace": F.when(F.col("price") % 20 == 1, F.lit("replay:-bad")).otherwise(F.col("namespace")),
            "quote_observed_at_ms": F.when(F.col("price") % 20 == 2, F.col("requested_at_ms") + 1).otherwise(F.col("quote_observed_at_ms")),
        }
    )
    return orders.order_violations(bent).select("idempotency_key", F.array_join("violations", ",").alias("violations"))


def order_admissions(t: FeedTables) -> DataFrame:
    return t.orders.select(
        "order_id", "idempotency_key", "market_id", "decision_id", "market_state", "market_state_version", "admission_reason_code",
        "status", "explanation", "quote_age_ms", F.col("requires_requote").cast("int").alias("requires_requote"),
        "circuit_breaker_receipt_id",
    )


def order_labels(t: FeedTables) -> DataFrame:
    again = t.order_requests.filter(F.col("price") % 4 == 0).withColumn("requested_at_ms", F.col("requested_at_ms") + 1)
    repeat = t.order_requests.filter(F.col("price") % 4 == 1)
    both = t.order_requests.unionByName(orders.order_ids(again.drop("order_id", "request_hash"))).unionByName(repeat)
    labelled = orders.label_orders(both)
    return labelled.groupBy("idempotency_key", "request_hash", "append_status").agg(F.count(F.lit(1)).alias("requests"))


def admission_audit(t: FeedTables) -> DataFrame:
    bent = t.orders.withColumn(
        "market_state_version", F.col("market_state_version") + F.when(F.col("price") % 15 == 0, F.lit(1)).otherwise(F.lit(0))
    )
    return orders.admission_violations(bent, t.decisions).select("order_id", F.array_join("violations", ",").alias("violations"))


def settlement_audit(t: FeedTables) -> DataFrame:
    bent = t.orders.withColumns(
        {
            "settlement": F.when(F.col("price") % 10 == 0, F.lit("won")),
            "settled_at_ms": F.when(F.col("price") % 10 <= 1, F.col("created_at_ms") + 1),
            "status": F.when(F.col("price") % 20 == 0, F.lit("settled")).otherwise(F.col("status")),
        }
    )
    return orders.settlement_violations(bent).select("order_id", F.array_join("violations", ",").alias("violations"))


# --- receipts ------------------------------------------------------------------------


def evidence_rows(t: FeedTables) -> DataFrame:
    found, _ = receipts.receipt_evidence(t.decisions, t.events)
    return found.select("decision_id", "event_id", "kind", "source_message_id", "score_stat_key")


def missing_evidence(t: FeedTables) -> DataFrame:
    kept = t.events.filter(F.col("source_timestamp_ms") % 10 != 0)
    _, missing = receipts.receipt_evidence(t.decisions, kept)
    return missing


def decision_receipts(t: FeedTables) -> DataFrame:
    return t.receipts.select("receipt_id", "decision_id", "payload_hash", "created_at_ms", "status")


def receipt_audit(t: FeedTables) -> DataFrame:
    doubled = F.when(F.col("created_at_ms") % 20 == 0, F.concat("evidence", "evidence")).otherwise(F.col("evidence"))
    return receipts.receipt_violations(t.receipts.withColumn("evidence", doubled)).select(
        "receipt_id", F.array_join("violations", ",").alias("violations")
    )


def pending_queue(t: FeedTables) -> DataFrame:
    return receipts.pending_receipts(t.receipts, 50).select("receipt_id", "updated_at_ms")


def proof_coordinates(t: FeedTables) -> DataFrame:
    return receipts.proof_coordinates(t.receipts).drop("receipt_id")


def _verification_updates(t: FeedTables) -> DataFrame:
    """Two updates per receipt; a fifth of the second ones run back in time or change the material."""
    both = t.receipt_heads.select(
        "receipt_id", "decision_id", "created_at_ms", F.explode(F.array(F.lit(1), F.lit(2))).alias("update_seq")
    )
    second = F.col("update_seq") == 2
    mod = F.col("created_at_ms") % 10
    return both.select(
        "receipt_id",
        F.col("update_seq").cast("long").alias("update_seq"),
        F.when(second & (mod == 0), F.lit(0)).otherwise(F.col("update_seq")).cast("long").alias("attempt_count"),
        (F.col("created_at_ms") + F.when(second & (mod == 1), F.lit(-5)).otherwise(F.col("update_seq") * 1000)).alias("updated_at_ms"),
        F.when(second & (mod == 2), F.lit("other")).otherwise(F.lit("material")).alias("proof_material_hash"),
        F.when(~second, F.lit("error")).when(mod < 6, F.lit("verified")).otherwise(F.lit("rejected")).alias("status"),
    )


def merged_verifications(t: FeedTables) -> DataFrame:
    merged = receipts.merge_verifications(t.receipts, _verification_updates(t))
    return merged.select("decision_id", "status", "attempt_count", "updated_at_ms", "proof_material_hash")


def verification_updates_audit(t: FeedTables) -> DataFrame:
    judged = receipts.judge_updates(_verification_updates(t)).filter(F.size("violations") > 0)
    return judged.join(t.receipts.select("receipt_id", "decision_id"), "receipt_id").select(
        "decision_id", "update_seq", F.array_join("violations", ",").alias("violations")
    )


def verification_audit(t: FeedTables) -> DataFrame:
    base = receipts.merge_verifications(t.receipt_heads, _verification_updates(t))
    filled = base.withColumns(
        {
            **{c: F.lit("x") for c in receipts.CHAIN_FIELDS if not c.endswith(("_ms", "_slot", "_hash"))},
            "attempted_at_ms": F.col("updated_at_ms"),
            "completed_at_ms": F.when(F.col("updated_at_ms") % 4 != 0, F.col("updated_at_ms")),
            "source_timestamp_ms": F.col("created_at_ms"),
            "simulation_slot": F.when(F.col("updated_at_ms") % 3 != 0, F.lit(1)),
            "error_code": F.when(F.col("updated_at_ms") % 5 != 0, F.lit("E")),
        }
    )
    bad = receipts.verification_violations(filled).join(t.receipt_heads.select("receipt_id", "decision_id"), "receipt_id")
    return bad.select("decision_id", F.array_join("violations", ",").alias("violations"))


def proof_outcomes(t: FeedTables) -> DataFrame:
    return receipts.proof_summary(receipts.merge_verifications(t.receipt_heads, _verification_updates(t)))


def proof_material_audit(t: FeedTables) -> DataFrame:
    rows = feed.base(t.spark, t.sf_dir).select(
        F.col("n").alias("material_id"),
        (F.col("user_id") % 12).alias("fixture_id"),
        F.when(F.col("k") % 20 == 0, F.lit(-1)).otherwise(F.col("user_id") % 12).alias("summary_fixture_id"),
        F.col("t").alias("ts"),
        (F.col("t") - F.col("k") + 3).alias("min_timestamp"),
        (F.col("t") + 98 - F.col("k")).alias("max_timestamp"),
    )
    return receipts.proof_material_violations(rows).select("material_id", F.array_join("violations", ",").alias("violations"))


# --- evaluation ----------------------------------------------------------------------


def protective_signals(t: FeedTables) -> DataFrame:
    return t.signals


def signal_baselines(t: FeedTables) -> DataFrame:
    return t.baseline.select("fixture_id", "market_id", "baseline_consensus_id", "baseline_t", "baseline_status")


def _anchors(t: FeedTables) -> tuple[DataFrame, DataFrame]:
    return t.anchor_signals, t.anchor_baseline


def first_moves(t: FeedTables) -> DataFrame:
    sig, base = _anchors(t)
    return evaluation.first_move(t.trace, sig, base, EVALUATION)


def convergences(t: FeedTables) -> DataFrame:
    sig, base = _anchors(t)
    return evaluation.convergence(t.trace, sig, base, EVALUATION).select("fixture_id", "convergence_t", "convergence_event_id")


def market_lifecycles(t: FeedTables) -> DataFrame:
    ends = t.events.groupBy("fixture_id").agg(F.max("source_timestamp_ms").alias("end_t"))
    return evaluation.lifecycle(t.sweep_decisions, t.signals, ends).drop("paused_decision_id", "reopened_decision_id")


def state_transitions(t: FeedTables) -> DataFrame:
    return evaluation.transition_counts(t.sweep_rows)


def state_transition_summary(t: FeedTables) -> DataFrame:
    return evaluation.transition_summary(evaluation.transition_counts(t.sweep_rows))


def control_windows(t: FeedTables) -> DataFrame:
    sig, base = _anchors(t)
    return evaluation.control_window(t.sweep_rows, sig, base)


def false_pauses(t: FeedTables) -> DataFrame:
    return evaluation.false_pause(t.events, t.signals)


def price_error_proxy(t: FeedTables) -> DataFrame:
    sig, base = _anchors(t)
    probes = evaluation.probe_orders(t.events, t.sweep_rows, sig)
    return evaluation.error_proxy(probes, evaluation.convergence(t.trace, sig, base, EVALUATION))


def probe_order_rows(t: FeedTables) -> DataFrame:
    sig, _ = _anchors(t)
    return evaluation.probe_orders(t.events, t.decisions, sig).select(
        "fixture_id", "order_id", "expected_state_version", "market_id", "outcome_id", "requested_at_ms", "requested_probability_micros"
    )


def evaluation_facts(t: FeedTables) -> DataFrame:
    return t.facts.select(
        "fixture_id", "policy_id", "signal_count", "transition_count", "flap_count", "false_pause_status", "pause_duration_ms",
        "pause_total_ms", "reopen_latency_ms", "control_decisions", "final_state", "decision_count",
    )


def evaluation_timeline(t: FeedTables) -> DataFrame:
    return evaluation.timeline(t.facts, t.probes).select("fixture_id", "policy_id", "at_ms", "kind", "event_id")


def evaluation_reports(t: FeedTables) -> DataFrame:
    return t.reports.select("fixture_id", "policy_id", "evaluation_hash", "final_state", "flap_count", "pause_duration_ms", "reopen_latency_ms")


def report_audit(t: FeedTables) -> DataFrame:
    bent = t.reports.withColumn(
        "report_json", F.when(F.col("policy_id") == "slow_reopen", F.concat("report_json", F.lit(" "))).otherwise(F.col("report_json"))
    )
    return bent.join(evaluation.report_violations(bent), "evaluation_hash").select("fixture_id", "policy_id")


def report_summaries(t: FeedTables) -> DataFrame:
    return evaluation.report_summary(t.facts).select("fixture_id", "policy_id", "pause_duration", "time_to_reopen", "final_state", "flap_count")


# --- provenance ----------------------------------------------------------------------


def replay_hashes(t: FeedTables) -> DataFrame:
    return provenance.chunked_hash(t.events)


def chunked_hashes(t: FeedTables) -> DataFrame:
    return provenance.chunked_hash(t.events, chunk_ms=86_400_000).drop("input_hash")


def sequence_hashes(t: FeedTables) -> DataFrame:
    return provenance.sequence_hash(t.events).drop("input_hash")


def replay_manifests(t: FeedTables) -> DataFrame:
    return t.manifest_rows.select("manifest_id", "fixture_id", "event_count", "source_start_ms", "source_end_ms", "strategy_hash")


def manifest_audit(t: FeedTables) -> DataFrame:
    kept = t.events.filter((F.col("fixture_id").cast("int") % 3 != 0) | (F.col("source_timestamp_ms") < MID_MS))
    bad = provenance.manifest_violations(kept, t.manifest_rows)
    return bad.select("fixture_id", F.array_join("violations", ",").alias("violations"))


def dispatch_order(t: FeedTables) -> DataFrame:
    return provenance.replay_order(t.events, "sample")


def run_log_audit(t: FeedTables) -> DataFrame:
    seq = F.explode(F.sequence(F.lit(0), F.lit(2)).cast("array<bigint>"))
    log = t.runs.select("*", seq.alias("update_seq"))
    n = F.substring_index("run_id", "-", -1).cast("long")
    status = F.when(F.col("update_seq") == 0, F.lit("pending")).when(F.col("update_seq") == 1, F.lit("running")).otherwise(F.col("status"))
    log = log.withColumns(
        {
            "status": status,
            "event_count": F.when(F.col("update_seq") == 2, F.col("event_count")).otherwise(F.col("update_seq") * 50),
            "completed_at_ms": F.when(status.isin("completed", "stopped", "failed"), F.col("completed_at_ms")),
            "last_event_id": F.lit("e"),
            "speed": F.when((F.col("update_seq") == 1) & (n % 11 == 0), F.lit("2")).otherwise(F.lit("maximum")),
            "input_fixture_id": F.lit("f"),
            "input_hash": F.lit("i"),
            "config_hash": F.lit("c"),
        }
    )
    limits = t.runs.select("manifest_id").distinct().withColumn("event_count", F.lit(99).cast("long"))
    bad = provenance.run_violations(log, limits)
    return bad.select("run_id", "update_seq", F.array_join("violations", ",").alias("violations"))


def reconciled_runs(t: FeedTables) -> DataFrame:
    return provenance.reconcile_runs(t.runs, NOW_MS).select(
        "run_id", "status", "completed_at_ms", F.col("recovered").cast("int").alias("recovered")
    )


def append_counts(t: FeedTables) -> DataFrame:
    return provenance.hydration_summary(t.labelled)


# --- views ---------------------------------------------------------------------------


def overview(t: FeedTables) -> DataFrame:
    t.keep_events()
    return views.overview(t.fixture_rows, t.decisions, t.orders, t.receipt_heads, t.runs)


def fixtures_view(t: FeedTables) -> DataFrame:
    scores = projections.latest_scores(t.events)
    return views.fixtures_view(t.latest_fixtures, scores, status="scheduled", n=10).select(
        "fixture_id", "competition", "scheduled_at_ms", "updated_at_ms", "action", "home_score", "away_score", "score_timestamp_ms"
    )


def _markets(t: FeedTables):
    return projections.latest_markets(t.events), projections.market_state(t.decisions), t.snapshot


def markets_view(t: FeedTables) -> DataFrame:
    return views.markets_view(*_markets(t), n=20).select(
        "market_id", "fixture_id", "updated_at_ms", "state", "state_version", "consensus_id", "consensus_status", "valid_bookmaker_count"
    )


def fixture_detail(t: FeedTables) -> DataFrame:
    detail = views.fixture_detail("3", t.latest_fixtures, projections.latest_scores(t.events), *_markets(t))
    return detail.select("fixture_id", "competition", "action", "home_score", "market_id", "state", "consensus_id")


def timeline_view(t: FeedTables) -> DataFrame:
    return views.timeline_view(projections.score_events(t.events), t.decisions, "3", MID_MS, 50).select("at_ms", "id", "kind", "detail")


def decisions_view(t: FeedTables) -> DataFrame:
    return views.decisions_view(t.decisions, fixture_id="5", n=40).select("decision_id", "logical_timestamp_ms", "next_state")


def receipts_view(t: FeedTables) -> DataFrame:
    return views.receipts_view(t.receipts, t.decisions, fixture_id="5", status="pending", n=40).select("receipt_id", "decision_id", "logical_timestamp_ms")


def orders_view(t: FeedTables) -> DataFrame:
    return views.orders_view(t.orders, fixture_id="5", namespace="live", status="rejected", n=40).select(
        "order_id", "created_at_ms", "admission_reason_code"
    )


def runs_view(t: FeedTables) -> DataFrame:
    return views.runs_view(t.runs, n=25).select("run_id", "status", "started_at_ms")


def event_page(t: FeedTables) -> DataFrame:
    first, cursor = views.event_page(t.events, "4", 20)
    page, after = views.event_page(t.events, "4", 20, cursor) if cursor else (first, None)
    return page.select("event_id", "source_timestamp_ms", "sequence", F.lit(after).alias("next_cursor"))


def market_maxima(t: FeedTables) -> DataFrame:
    return views.market_maxima(t.trace)


# --- operations ----------------------------------------------------------------------


def purged_records(t: FeedTables) -> DataFrame:
    raw = norm.raw_records(t.normalized, F.col("received_at_ms") + 86_400_000).withColumn(
        "source", F.when(F.col("source_timestamp_ms") % 2 == 0, F.lit(LABELS.historical)).otherwise(F.col("source"))
    )
    purged = ops.purge_expired(raw, MID_MS)
    return purged.groupBy("payload_kind", "source", F.col("purged").cast("int").alias("purged")).agg(
        F.count(F.lit(1)).alias("records"), F.count("raw_payload").alias("payloads")
    )


def feed_health(t: FeedTables) -> DataFrame:
    return ops.feed_health(t.labelled, NOW_MS)


def tracked_fixtures(t: FeedTables) -> DataFrame:
    return ops.tracked_fixtures(t.labelled)


def bucketed_feed_health(t: FeedTables) -> DataFrame:
    return ops.bucketed_feed_health(t.labelled)


def request_metrics(t: FeedTables) -> DataFrame:
    return ops.request_metrics(t.requests)


def latency_percentiles(t: FeedTables) -> DataFrame:
    return ops.latency_percentiles(t.requests)


NAMED: tuple[Callable[[FeedTables], DataFrame], ...] = (
    consensus_trace, consensus_outcomes, consensus_diagnostics, consensus_at_time, normalized_vectors, latest_quotes,
    quote_freshness, reaction_latencies, core_markets, score_classes, snapshot_risk_features, threshold_reasons,
    attributed_events, event_time_features, event_time_decisions, risk_decisions, decision_payloads, policy_sweep_decisions, fanned_out_decisions, resumed_decisions,
    restart_states, late_inputs, transition_audit, namespaced_markets,
    feed_messages, bucket_coordinates, planned_buckets, source_range, hydration_events, hydration_counts, append_conflicts,
    normalized_odds, normalized_scores, normalized_fixtures, quarantine, raw_identity, odds_issue_counts, envelope_audit,
    raw_event_audit, event_shape_audit, world_cup_fixtures,
    append_labels, payload_conflicts, event_key_conflicts, decision_payload_conflicts, version_audit,
    latest_fixture_rows, latest_market_rows, quote_rows, score_history, latest_score_rows, control_states,
    order_audit, order_admissions, order_labels, admission_audit, settlement_audit,
    evidence_rows, missing_evidence, decision_receipts, receipt_audit, pending_queue, proof_coordinates, merged_verifications,
    verification_updates_audit, verification_audit, proof_outcomes, proof_material_audit,
    protective_signals, signal_baselines, first_moves, convergences, market_lifecycles, state_transitions,
    state_transition_summary, control_windows, false_pauses, price_error_proxy, probe_order_rows, evaluation_facts,
    evaluation_timeline, evaluation_reports, report_audit, report_summaries,
    replay_hashes, chunked_hashes, sequence_hashes, replay_manifests, manifest_audit, dispatch_order, run_log_audit, reconciled_runs, append_counts,
    overview, fixtures_view, markets_view, fixture_detail, timeline_view, decisions_view, receipts_view, orders_view, runs_view,
    event_page, market_maxima,
    purged_records, feed_health, tracked_fixtures, bucketed_feed_health, request_metrics, latency_percentiles,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(query: Callable[[FeedTables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: query(tables(spark, sf_dir))

    return {query.__name__: bind(query) for query in NAMED}


