"""Risk features, threshold reasons and the OPEN / WIDENED / PAUSED / RECOVERY fold.

All that does not depend on the control state -- shock holds, reasons, recovery health --
is computed as Columns.  What is left is a small automaton.  A row that must start a
recovery whatever happened before it (a *sync row*) cuts a market's history into
segments with a known entry state, so the segments of one market fold in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import LEGAL_TRANSITIONS, RISK_POLICY_VERSION, ConsensusConfig, RiskPolicy
from tidemark.functions import canonical as cj
from tidemark.functions.scans import Running, chunk_of, running
from tidemark.functions.staging import stage
from tidemark.operators import automaton
from tidemark.operators.classify import NORMAL, SIGNAL_FIELDS, score_signal
from tidemark.operators.consensus import probed_consensus, quote_vectors
from tidemark.schemas import event_order

# --- fixed values -------------------------------------------------------------------
NON_BLOCKING = "PROOF_NOT_READY_NON_BLOCKING"
SEVERITY_METRIC = {"none": 0, "low": 1, "high": 2, "critical": 3}
PROOF_METRIC = {"unavailable": 0, "pending": 1, "verified": 2, "failed": 3}
# ------------------------------------------------------------------------------------

FEATURE_FIELDS = (
    "consensus_status",
    "fresh_bookmaker_count",
    "max_abs_velocity",
    "max_dispersion",
    "max_reaction_latency_ms",
    "oldest_fresh_age_ms",
    "stale_ppm",
    "unreacted_count",
)
# fixed values: names of the features in the hashed payload, in the order of FEATURE_FIELDS
_FEATURE_JSON = (
    "consensusStatus",
    "freshBookmakerCount",
    "maxAbsVelocityMicrosPerSecond",
    "maxDispersionMadMicros",
    "maxReactionLatencyMs",
    "oldestFreshQuoteAgeMs",
    "staleBookmakerFractionPpm",
    "unreactedBookmakerCount",
)

# the automaton travels inside the task, so executors need no copy of this package
cloudpickle.register_pickle_by_value(automaton)


def snapshot_features(max_reaction: Column | None = None, unreacted: Column | None = None) -> Column:
    """Feature struct of a consensus snapshot row."""
    null_long = F.lit(None).cast("long")
    return F.struct(
        F.col("status").alias("consensus_status"),
        F.col("fresh_bookmaker_count").cast("long").alias("fresh_bookmaker_count"),
        F.array_max(F.transform("outcomes", lambda o: F.abs(o["velocity_micros_per_s"]))).alias("max_abs_velocity"),
        F.array_max(F.transform("outcomes", lambda o: o["dispersion_micros"])).alias("max_dispersion"),
        (null_long if max_reaction is None else max_reaction).alias("max_reaction_latency_ms"),
        F.col("oldest_fresh_age_ms").cast("long").alias("oldest_fresh_age_ms"),
        F.col("stale_ppm").alias("stale_ppm"),
        (F.lit(0).cast("long") if unreacted is None else unreacted).alias("unreacted_count"),
    )


def risk_features(snapshots: DataFrame, reactions: DataFrame | None = None) -> DataFrame:
    """Features per snapshot; ``reactions`` (market_id, bookmaker_id, latency_ms) are optional."""
    if reactions is None:
        featured = snapshots.withColumn("f", snapshot_features())
    else:
        totals = reactions.groupBy("market_id").agg(
            F.max("latency_ms").alias("max_reaction"), F.count_if(F.col("latency_ms").isNull()).alias("unreacted")
        )
        joined = snapshots.join(totals, "market_id", "left")
        featured = joined.withColumn(
            "f", snapshot_features(F.col("max_reaction"), F.coalesce(F.col("unreacted"), F.lit(0)))
        )
    return featured.select("market_id", "event_id", "t", *[F.col(f"f.{n}").alias(n) for n in FEATURE_FIELDS])


def policy_struct(policy: RiskPolicy, label: str) -> Column:
    fields = [F.lit(v).cast("long").alias(k) for k, v in asdict(policy).items()]
    return F.struct(
        F.lit(label).alias("policy_id"), F.lit(policy.configuration_hash).alias("configuration_hash"), *fields
    )


def market_reasons(f: Column, p: Column, proof: Column) -> tuple[Column, Column]:
    """Ordered pause and widen reason arrays for features ``f`` under policy struct ``p``."""
    unavailable = (
        (f["consensus_status"] != "ready")
        | (f["fresh_bookmaker_count"] < p["minimum_fresh_bookmakers"])
        | f["oldest_fresh_age_ms"].isNull()
    )
    age = f["oldest_fresh_age_ms"]

    def banded(value: Column, limit: str, pause_code: str, widen_code: str) -> tuple[Column, Column]:
        over, near = value >= p[f"pause_{limit}"], value >= p[f"widen_{limit}"]
        return F.when(over, F.lit(pause_code)), F.when(~over & near, F.lit(widen_code))

    age_pause, age_widen = banded(age, "quote_age_ms", "QUOTE_AGE_PAUSE", "QUOTE_AGE_WIDEN")
    pairs = [
        (
            F.when(unavailable, F.lit("MARKET_DATA_UNAVAILABLE")).otherwise(age_pause),
            F.when(~unavailable, age_widen),
        ),
        banded(
            f["stale_ppm"], "stale_bookmaker_fraction_ppm", "STALE_BOOKMAKER_QUORUM", "STALE_BOOKMAKER_WARNING"
        ),
        banded(
            f["max_abs_velocity"],
            "velocity_micros_per_second",
            "CONSENSUS_VELOCITY_PAUSE",
            "CONSENSUS_VELOCITY_WIDEN",
        ),
        banded(f["max_dispersion"], "dispersion_micros", "CONSENSUS_DISPERSION_PAUSE", "CONSENSUS_DISPERSION_WIDEN"),
        banded(
            f["max_reaction_latency_ms"],
            "reaction_latency_ms",
            "BOOKMAKER_REACTION_SLOW",
            "BOOKMAKER_REACTION_WARNING",
        ),
    ]
    pause = [a for a, _ in pairs] + [F.when(proof == "failed", F.lit("PROOF_VERIFICATION_FAILED"))]
    widen = [b for _, b in pairs] + [F.when(f["unreacted_count"] > 0, F.lit("BOOKMAKER_REACTION_UNOBSERVED"))]
    return F.array_compact(F.array(*pause)), F.array_compact(F.array(*widen))


def recovery_healthy(f: Column, p: Column, proof: Column) -> Column:
    zero = F.lit(0)
    tests = (
        (proof != "failed")
        & (f["consensus_status"] == "ready")
        & (f["fresh_bookmaker_count"] >= p["minimum_fresh_bookmakers"])
        & (f["oldest_fresh_age_ms"] <= p["recovery_quote_age_ms"])
        & (f["stale_ppm"] <= p["recovery_stale_bookmaker_fraction_ppm"])
        & (F.coalesce(f["max_abs_velocity"], zero) <= p["recovery_velocity_micros_per_second"])
        & (F.coalesce(f["max_dispersion"], zero) <= p["recovery_dispersion_micros"])
        & (f["unreacted_count"] == 0)
    )
    return F.coalesce(tests, F.lit(False))


def attribute(
    events: DataFrame, trace: DataFrame, config: ConsensusConfig, fanout: str = "last_market", feature_time: str = "snapshot"
) -> DataFrame:
    """Give every event a market and the features it is judged by.

    An odds event belongs to its own market; any other event to the market of the most
    recent observation of its fixture, and is skipped while there is none.  With
    ``fanout='all_markets'`` such events go to every market of the fixture observed so far.

    An event that observes nothing itself is judged by the last snapshot as it was, or with
    ``feature_time='event'`` by the market's quotes as old as they are at the event's own time.
    """
    if feature_time not in ("snapshot", "event"):
        raise ValueError(f"unknown feature time {feature_time!r}")
    observed = trace.select("event_id", F.col("market_id").alias("obs_market"), snapshot_features().alias("obs_features"))
    signal = F.expr(f"CASE WHEN kind = 'score.observed' THEN {score_signal()} END")
    base = events.select(
        "event_id",
        "fixture_id",
        "kind",
        F.col("source_timestamp_ms").alias("t"),
        event_order().alias("ord"),
        chunk_of(F.col("source_timestamp_ms"), config.chunk_ms).alias("chunk"),
        F.col("odds.market.market_id").alias("own_market"),
        signal.alias("signal"),
    ).join(observed, "event_id", "left")
    latest = F.when(
        F.col("obs_market").isNotNull(), F.struct(F.col("obs_market").alias("market_id"), F.col("obs_features").alias("f"))
    )
    if fanout == "last_market":
        known = running(base, ["fixture_id"], "ord", "chunk", [Running("latest", "last", latest)])
        placed = known.filter(F.col("latest").isNotNull()).withColumn(
            "market_id", F.coalesce("own_market", F.col("latest.market_id"))
        )
    elif fanout == "all_markets":
        markets = base.filter("own_market IS NOT NULL").select("fixture_id", F.col("own_market").alias("market_id")).distinct()
        own = base.filter("own_market IS NOT NULL").withColumn("market_id", F.col("own_market"))
        spread = base.filter("own_market IS NULL").join(markets, "fixture_id")
        every = own.unionByName(spread)
        placed = running(every, ["market_id"], "ord", "chunk", [Running("latest", "last", latest)]).filter(
            F.col("latest").isNotNull()
        )
    else:
        raise ValueError(f"unknown fanout {fanout!r}")
    columns = ["market_id", "event_id", "fixture_id", "kind", "t", "ord", "chunk", "signal"]
    if feature_time == "snapshot":
        return placed.select(*columns, F.col("latest.f").alias("features"))
    placed = stage(placed.select(*columns, "obs_market", F.col("latest.market_id").alias("seen_market"), F.col("latest.f").alias("kept")))
    probe = F.col("seen_market").alias("market_id")
    probes = placed.filter("obs_market IS NULL").select(probe, "event_id", "fixture_id", "ord", "t").distinct()
    aged = probed_consensus(quote_vectors(events), trace, probes, config).select(
        F.col("market_id").alias("seen_market"), "event_id", snapshot_features().alias("aged")
    )
    rows = placed.join(aged, ["seen_market", "event_id"], "left")
    return rows.select(*columns, F.coalesce("aged", "kept").alias("features"))


def namespace_market(namespace: str, market: str) -> str:
    """Market id isolated inside an evaluation: namespace plus 32 hex of the market's hash."""
    return f"concat_ws(':', {namespace}, substring({cj.digest(cj.text(market))}, 1, 32))"


def replay_resource(run_id: str, resource: str) -> str:
    return f"concat_ws(':', 'replay', {run_id}, {resource})"


# --- the fold ----------------------------------------------------------------------


def _scan(inputs: DataFrame, initial: DataFrame | None) -> DataFrame:
    """What no policy changes: earlier pause signals, times and versions of a market, its restored state.

    (market_id, chunk, state_version) names one row of the result.
    """
    s = F.col("signal")
    is_pause = F.coalesce(s["protective_action"] == "pause", F.lit(False))
    is_reversal = is_pause & (s["confirmation"] == "reversal")
    mark = F.struct("ord", "t")
    scanned = running(
        inputs,
        ["market_id"],
        "ord",
        "chunk",
        [
            Running("rev", "last", F.when(is_reversal, mark)),
            Running("hit", "last", F.when(is_pause & ~is_reversal, mark)),
            Running("rev0", "last", F.when(is_reversal, mark), inclusive=False),
            Running("hit0", "last", F.when(is_pause & ~is_reversal, mark), inclusive=False),
            Running("previous_t", "last", F.col("t"), inclusive=False),
            Running("version0", "sum", F.lit(1).cast("long"), inclusive=False),
        ],
    )
    if initial is not None:
        restored = initial.select(
            "market_id",
            F.col("state").alias("i_state"),
            F.col("state_version").alias("i_version"),
            F.col("last_state_change_ms").alias("i_change"),
            F.col("stable_updates").alias("i_stable"),
            F.col("shock_until_ms").alias("i_shock"),
            F.col("last_logical_ms").alias("i_last_t"),
        )
        scanned = scanned.join(restored, "market_id", "left")
    else:
        scanned = scanned.withColumns(
            {
                "i_state": F.lit(None).cast("string"),
                **{n: F.lit(None).cast("long") for n in ("i_version", "i_change", "i_stable", "i_shock", "i_last_t")},
            }
        )
    # a reversal replaces the hold, any other pause signal extends it
    newer = lambda rev, hit: F.col(hit).isNotNull() & (F.col(rev).isNull() | (F.col(f"{hit}.ord") > F.col(f"{rev}.ord")))
    return scanned.withColumns(
        {
            "held": F.struct(F.col("rev.t").alias("rev_t"), F.col("hit.t").alias("hit_t"), newer("rev", "hit").alias("hit_is_newer")),
            "held0": F.struct(F.col("rev0.t").alias("rev_t"), F.col("hit0.t").alias("hit_t"), newer("rev0", "hit0").alias("hit_is_newer")),
            "previous_t": F.coalesce("previous_t", "i_last_t", F.lit(0)),
            "state_version": F.col("version0") + F.coalesce("i_version", F.lit(0)),
        }
    ).drop("rev", "hit", "rev0", "hit0", "version0", "i_version", "i_last_t")


def _judge(scanned: DataFrame) -> DataFrame:
    """State-independent part: reasons, shock holds, health, per (market, policy) row; row by row."""
    s, p = F.col("signal"), F.col("policy")
    is_pause = F.coalesce(s["protective_action"] == "pause", F.lit(False))

    def shock(held: str) -> Column:
        # time never runs back
        reversed_until = F.col(f"{held}.rev_t") + p["reversal_shock_hold_ms"]
        held_until = F.col(f"{held}.hit_t") + p["critical_shock_hold_ms"]
        floor = F.when(F.col(f"{held}.rev_t").isNotNull(), reversed_until).otherwise(F.coalesce("i_shock", F.lit(0)))
        return F.when(F.col(f"{held}.hit_is_newer"), F.greatest(floor, held_until)).otherwise(floor)

    held = scanned.withColumns({"shock_until_ms": shock("held"), "previous_shock_ms": shock("held0")}).drop("held", "held0")
    f, proof = F.col("features"), F.col("proof_status")
    pause_codes, widen_codes = market_reasons(f, p, proof)
    own_pause = F.when(is_pause, F.array(s["reason_code"])).otherwise(F.array().cast("array<string>"))
    own_widen = F.when(s["protective_action"] == "widen", F.array(s["reason_code"])).otherwise(
        F.array().cast("array<string>")
    )
    hold = F.when(F.col("shock_until_ms") > F.col("t"), F.array(F.lit("EVENT_SHOCK_HOLD"))).otherwise(
        F.array().cast("array<string>")
    )
    judged = held.withColumns(
        {
            "pause_reasons": F.concat(own_pause, pause_codes, hold),
            "widen_reasons": F.concat(own_widen, widen_codes),
            "healthy": recovery_healthy(f, p, proof),
        }
    )
    return judged.withColumns({"pause": F.size("pause_reasons") > 0, "widen": F.size("widen_reasons") > 0})


def _segments(judged: DataFrame) -> DataFrame:
    """Cut each (market, policy) at sync rows and attach the entry state of every segment.

    A row is a sync row when it may start a recovery, the last pausing row lies at least
    the minimum pause time back, and no row in between may start one: the market is then
    PAUSED, for long enough, whatever came before.  The last pausing row and the last row
    that may start a recovery are carried over chunks, so a pause may be of any length.
    Versions of a market count in event order, so rows are ordered by them.
    """
    key = ["market_id", "policy_id"]
    can_start = ~F.col("pause") & F.col("healthy")
    seen = [
        Running("__p", "last", F.when(F.col("pause"), F.struct("state_version", "t")), inclusive=False),
        Running("__h", "last", F.when(can_start, F.col("state_version")), inclusive=False),
    ]
    local = running(judged, key, "state_version", "chunk", seen)
    sync = (
        can_start
        & F.col("__p").isNotNull()
        & (F.col("__h").isNull() | (F.col("__h") < F.col("__p.state_version")))
        & (F.col("t") - F.col("__p.t") >= F.col("minimum_pause_ms"))
    )
    marked = local.withColumn("__sync", F.coalesce(sync, F.lit(False))).drop("__p", "__h")
    # the sync row itself still belongs to the segment before it, whose fold knows its entry
    cut = running(
        marked,
        key,
        "state_version",
        "chunk",
        [Running("entry", "last", F.when(F.col("__sync"), F.struct(F.col("chunk").alias("in_chunk"), "state_version", "t")), inclusive=False)],
    )
    started = F.col("entry").isNotNull()
    return cut.withColumns(
        {
            "seg_key": F.concat_ws("|", "policy_id", "market_id", F.concat_ws("@", "entry.in_chunk", "entry.state_version")),
            "entry_state": F.when(started, F.lit("RECOVERY")).otherwise(F.coalesce("i_state", F.lit("OPEN"))),
            "entry_change_ms": F.when(started, F.col("entry.t")).otherwise(F.col("i_change")),
            "entry_stable": F.when(started, F.lit(1)).otherwise(F.coalesce("i_stable", F.lit(0))).cast("long"),
        }
    ).drop("entry", "__sync", "i_state", "i_change", "i_stable")


def _scanned(inputs: DataFrame, proof_status: str, initial: DataFrame | None) -> DataFrame:
    on_time = inputs if initial is None else _not_late(inputs, initial)
    proofs = on_time if "proof_status" in inputs.columns else on_time.withColumn("proof_status", F.lit(proof_status))
    return _scan(proofs, initial)


def _cut(scanned: DataFrame, policies: dict[str, RiskPolicy]) -> DataFrame:
    """Of every row and policy only what the fold reads, in segments."""
    variants = F.array(*[policy_struct(policy, label) for label, policy in policies.items()])
    # every row meets every policy of the literal list; nothing is shuffled for it
    judged = _judge(scanned.withColumn("policy", F.explode(variants)))
    return _segments(
        judged.select(
            "market_id", F.col("policy.policy_id").alias("policy_id"), "chunk", "state_version", "t", "pause", "widen", "healthy",
            *[F.col(f"policy.{n}").alias(n) for n in automaton.FOLD_LIMITS], "i_state", "i_change", "i_stable",
        )
    )


def segments(inputs: DataFrame, policies: dict[str, RiskPolicy], proof_status: str = "unavailable", initial: DataFrame | None = None) -> DataFrame:
    """Judged inputs of every policy, cut into the segments (``seg_key``) that fold on their own."""
    return _cut(_scanned(inputs, proof_status, initial), policies)


def decide(
    inputs: DataFrame,
    policies: dict[str, RiskPolicy],
    policy_version: str = RISK_POLICY_VERSION,
    proof_status: str = "unavailable",
    initial: DataFrame | None = None,
) -> DataFrame:
    """One decision per input row and policy.

    ``inputs`` is the result of `attribute`, unique per (market, event).  Every policy is a
    literal in the plan, so a sweep over many policies is one job.  Rows older than the
    restored state of their market yield no decision; see `late_inputs`.
    """
    # the versions it gives are read by the fold and by the rows that its states come back to
    scanned = stage(_scanned(inputs, proof_status, initial))
    arranged = _cut(scanned, policies).repartition("seg_key").sortWithinPartitions("seg_key", "chunk", "state_version")
    schema = T.StructType(arranged.schema.fields + T.StructType.fromDDL(automaton.STATE_DDL).fields)
    row = F.struct("market_id", "chunk", "state_version").alias("row")  # its fields may be null, itself it is not
    states = arranged.mapInArrow(automaton.fold_partition, schema).select(row, "policy_id", *automaton.STATE_NAMES)
    policy = F.coalesce(*[F.when(F.col("policy_id") == label, policy_struct(policy, label)) for label, policy in policies.items()])
    judged = _judge(scanned.select("*", row).join(states, "row").withColumn("policy", policy))
    return decision_rows(judged.withColumn("policy_configuration_hash", F.col("policy.configuration_hash")), policy_version)


def fold_inputs(
    inputs: DataFrame, policies: dict[str, RiskPolicy], proof_status: str = "unavailable", carry: Sequence[str] = ()
) -> DataFrame:
    """Stateless half of the fold for the streaming processors, one row per input and policy.

    ``pause_reasons`` and ``widen_reasons`` lack only the hold that the fold itself keeps.
    ``carry`` names further input columns to keep.
    """
    variants = F.array(*[policy_struct(policy, label) for label, policy in policies.items()])
    rows = inputs.withColumns({"policy": F.explode(variants), "proof_status": F.lit(proof_status)})
    s, p = F.col("signal"), F.col("policy")
    pause, widen = market_reasons(F.col("features"), p, F.col("proof_status"))
    is_pause = F.coalesce(s["protective_action"] == "pause", F.lit(False))
    own = lambda action: F.array_compact(F.array(F.when(s["protective_action"] == action, s["reason_code"])))
    return rows.select(
        "market_id",
        p["policy_id"].alias("policy_id"),
        "event_id",
        "t",
        F.col("ord.sequence").alias("sequence"),
        F.col("ord.source_id").alias("source_id"),
        "ord",
        is_pause.alias("pause_signal"),
        (is_pause & (s["confirmation"] == "reversal")).alias("reversal"),
        (F.size(pause) > 0).alias("market_pause"),
        ((F.size(widen) > 0) | F.coalesce(s["protective_action"] == "widen", F.lit(False))).alias("widen"),
        recovery_healthy(F.col("features"), p, F.col("proof_status")).alias("healthy"),
        "fixture_id",
        "kind",
        "chunk",
        "signal",
        "features",
        "proof_status",
        F.concat(own("pause"), pause).alias("pause_reasons"),
        F.concat(own("widen"), widen).alias("widen_reasons"),
        p["configuration_hash"].alias("policy_configuration_hash"),
        *carry,
        *[p[n].alias(n) for n in ("critical_shock_hold_ms", "reversal_shock_hold_ms", *automaton.FOLD_LIMITS)],
    )


def decision_rows(folded: DataFrame, policy_version: str) -> DataFrame:
    """Folded inputs as decisions: ordered reason codes, metrics, feature hash and ids."""
    s, f = F.col("signal"), F.col("features")
    normal = F.struct(*[F.lit(v).alias(n) for v, n in zip(NORMAL, SIGNAL_FIELDS)])
    is_score = F.col("kind") == "score.observed"
    version = F.lit(policy_version)
    not_ready = F.col("proof_status").isin("pending", "unavailable")
    extra = F.array_compact(
        F.array(
            F.when(not_ready, F.lit(NON_BLOCKING)),
            F.when(is_score, s["reason_code"]),
            F.when(F.col("action") == "begin_recovery", F.lit("RECOVERY_CONVERGENCE_STARTED")),
            F.when(F.col("action") == "reopen", F.lit("RECOVERY_QUORUM_SATISFIED")),
            F.when(
                (F.col("action") == "none") & ~F.col("pause") & ~F.col("widen") & ~not_ready,
                F.lit("NO_RISK_THRESHOLD_CROSSED"),
            ),
        )
    )
    named = folded.withColumns(
        {
            "policy_version": version,
            "evidence_event_ids": F.array("event_id"),
            "reason_codes": F.array_distinct(F.concat("pause_reasons", "widen_reasons", extra)),
            "used_signal": F.coalesce(s, normal),
        }
    )
    key = cj.decision_key("event_id", "market_id", cj.literal(policy_version), "policy_configuration_hash")
    u = F.col("used_signal")
    feature_json = cj.obj(
        {
            json_name: (cj.plain if name == "consensus_status" else cj.scalar)(f"features.{name}")
            for json_name, name in zip(_FEATURE_JSON, FEATURE_FIELDS)
        }
    )
    previous_json = cj.obj(
        {
            "fixtureId": cj.text("fixture_id"),
            "lastLogicalTimestampMs": cj.scalar("previous_t"),
            "lastStateChangeAtMs": cj.scalar("previous_change_ms"),
            "marketId": cj.text("market_id"),
            "recoveryStableUpdates": cj.scalar("previous_stable_updates"),
            "shockUntilMs": cj.scalar("previous_shock_ms"),
            "state": cj.plain("previous_state"),
            "stateVersion": cj.scalar("state_version"),
        }
    )
    signal_json = cj.obj(
        {
            "confirmation": cj.plain("used_signal.confirmation"),
            "kind": cj.plain("used_signal.kind"),
            "protectiveAction": cj.plain("used_signal.protective_action"),
            "reasonCode": cj.plain("used_signal.reason_code"),
            "severity": cj.plain("used_signal.severity"),
        }
    )
    feature_hash = cj.digest(
        cj.obj(
            {
                "evidenceEventIds": cj.items("evidence_event_ids", "e", cj.text("e")),
                "features": feature_json,
                "fixtureId": cj.text("fixture_id"),
                "logicalTimestampMs": cj.scalar("t"),
                "marketId": cj.text("market_id"),
                "previous": previous_json,
                "proofStatus": cj.plain("proof_status"),
                "scoreSignal": signal_json,
                "triggerEventId": cj.text("event_id"),
            }
        )
    )
    named = named.withColumn("idempotency_key", F.expr(key))
    code = lambda table, col: F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), col).cast("long")
    metric = lambda name: F.coalesce(f[name], F.lit(-1)).cast("long")
    metrics = F.struct(
        F.greatest(F.lit(0), F.col("shock_until_ms") - F.col("t")).alias("active_shock_remaining_ms"),
        metric("fresh_bookmaker_count").alias("fresh_bookmaker_count"),
        F.col("state_change_ms").alias("last_state_change_at_ms"),
        metric("max_abs_velocity").alias("max_abs_velocity_micros_per_second"),
        metric("max_dispersion").alias("max_dispersion_mad_micros"),
        metric("max_reaction_latency_ms").alias("max_reaction_latency_ms"),
        metric("oldest_fresh_age_ms").alias("oldest_fresh_quote_age_ms"),
        code(PROOF_METRIC, F.col("proof_status")).alias("proof_status"),
        F.col("stable_updates").alias("recovery_stable_updates"),
        code(SEVERITY_METRIC, u["severity"]).alias("score_severity"),
        F.col("shock_until_ms").alias("shock_until_ms"),
        metric("stale_ppm").alias("stale_bookmaker_fraction_ppm"),
        metric("unreacted_count").alias("unreacted_bookmaker_count"),
    )
    return named.select(
        F.expr(cj.decision_id("idempotency_key")).alias("decision_id"),
        "idempotency_key",
        "policy_id",
        "fixture_id",
        "market_id",
        F.col("event_id").alias("trigger_event_id"),
        "ord",
        "chunk",
        "action",
        "previous_state",
        "next_state",
        F.col("state_version").alias("expected_state_version"),
        F.col("t").alias("logical_timestamp_ms"),
        "reason_codes",
        "evidence_event_ids",
        metrics.alias("metrics"),
        "policy_version",
        "policy_configuration_hash",
        F.expr(feature_hash).alias("input_feature_hash"),
        F.col("used_signal").alias("signal"),
    )


def _not_late(inputs: DataFrame, initial: DataFrame) -> DataFrame:
    known = initial.select("market_id", F.col("last_logical_ms").alias("__last"))
    return inputs.join(known, "market_id", "left").filter(F.col("__last").isNull() | (F.col("t") >= F.col("__last"))).drop("__last")


def late_inputs(inputs: DataFrame, initial: DataFrame) -> DataFrame:
    """Inputs older than the last applied time of their market: reported, never applied."""
    known = initial.select("market_id", F.col("last_logical_ms").alias("last_applied_ms"))
    return inputs.join(known, "market_id").filter(F.col("t") < F.col("last_applied_ms")).select(
        "market_id", "event_id", "t", "last_applied_ms", F.lit("late").alias("status")
    )


def state_from_decisions(decisions: DataFrame) -> DataFrame:
    """Restart state per market: what the last decision's metrics say."""
    last = F.max_by(F.struct("fixture_id", "decision_id", "next_state", "expected_state_version", "logical_timestamp_ms", "metrics"), "expected_state_version")
    return decisions.groupBy("market_id").agg(last.alias("d")).select(
        "market_id",
        "d.fixture_id",
        F.col("d.decision_id").alias("last_decision_id"),
        F.col("d.next_state").alias("state"),
        (F.col("d.expected_state_version") + 1).alias("state_version"),
        F.col("d.logical_timestamp_ms").alias("last_logical_ms"),
        F.col("d.metrics.last_state_change_at_ms").alias("last_state_change_ms"),
        F.col("d.metrics.recovery_stable_updates").alias("stable_updates"),
        F.col("d.metrics.shock_until_ms").alias("shock_until_ms"),
    )


def illegal_transitions(decisions: DataFrame) -> DataFrame:
    """Decisions whose (action, from, to) is not one of the legal transitions."""
    legal = F.lit(False)
    for action, before, after in LEGAL_TRANSITIONS:
        legal = legal | ((F.col("action") == action) & (F.col("previous_state") == before) & (F.col("next_state") == after))
    return decisions.filter(~F.coalesce(legal, F.lit(False)))


def risk_inputs(
    events: DataFrame, trace: DataFrame, config: ConsensusConfig, fanout: str = "last_market", feature_time: str = "snapshot"
) -> DataFrame:
    return stage(attribute(events, trace, config, fanout, feature_time))
