"""Evaluation of policies over traces: one report per (fixture, policy).

Inputs are the event table, the consensus observations (`consensus_trace`), the decisions
of every policy and, optionally, rejected quotes.  A fixture has one signal, so all
per-fixture facts are aggregates with map-side combine; no step pairs observations with
each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import EvaluationConfig, RiskPolicy, canonical_text
from tidemark.functions import canonical as cj
from tidemark.functions.integers import div, mean_rounded
from tidemark.functions.staging import stage
from tidemark.operators.classify import classify_scores
from tidemark.operators.consensus import max_delta, normalize_vectors, quote_vectors, reaction_latency
from tidemark.operators.orders import order_ids
from tidemark.schemas import ORDER_FIELDS

# --- fixed values -----------------------------------------------------------------
PROXY_LABEL = "absolute-probability-distance-proxy-not-pnl"
LIMITATIONS = (
    "The avoided-price-error value is an absolute probability-distance proxy, not P&L, profit, or causal attribution.",
    "An unconfirmed event without a later confirmation or reversal remains indeterminate; it is not labelled a false positive.",
    "Reaction latency is limited to bookmakers and reported probabilities present in the evaluated feed.",
    "A seeded-simulation report demonstrates deterministic behavior, not historical production performance.",
)
TIMELINE_LABELS = {
    "normal_control_started": "Normal-play control window opened with a ready consensus.",
    "market_paused": "Deterministic policy entered PAUSED.",
    "consensus_moved": "Consensus crossed the configured material-move threshold.",
    "consensus_converged": "Post-event consensus began the stable convergence window.",
    "paper_order_rejected": "A simulated paper order was rejected; no real money was involved.",
    "market_reopened": "Recovery quorum reopened the simulated market.",
}
# ----------------------------------------------------------------------------------

#: What the steps below read of a decision.
DECISION_COLUMNS = (
    "decision_id", "policy_id", "fixture_id", "market_id", "ord", "previous_state", "next_state", "expected_state_version",
    "logical_timestamp_ms", "policy_version", "policy_configuration_hash",
)


def signals(events: DataFrame) -> DataFrame:
    """Per fixture: the first protective signal, and how many there are."""
    protective = classify_scores(events).filter("protective_action <> 'none'")
    order = F.struct(*ORDER_FIELDS)
    first = F.min_by(F.struct("event_id", "source_timestamp_ms", "kind", "confirmation"), order)
    return protective.groupBy("fixture_id").agg(first.alias("s"), F.count(F.lit(1)).alias("signal_count")).select(
        "fixture_id",
        F.col("s.event_id").alias("signal_event_id"),
        F.col("s.source_timestamp_ms").alias("signal_t"),
        F.col("s.kind").alias("signal_kind"),
        F.col("s.confirmation").alias("signal_confirmation"),
        "signal_count",
    )


def _obs_order() -> Column:
    return F.struct(F.col("snapshot_t").alias("t"), F.col("event_id").alias("id"))


def baseline(trace: DataFrame, sig: DataFrame) -> DataFrame:
    """Per fixture: the last observation strictly before the signal."""
    before = trace.join(sig.select("fixture_id", "signal_t"), "fixture_id").filter("snapshot_t < signal_t")
    last = F.max_by(F.struct("market_id", "consensus_id", "snapshot_t", "status", "outcomes"), _obs_order())
    return before.groupBy("fixture_id").agg(last.alias("b")).select(
        "fixture_id",
        F.col("b.market_id").alias("market_id"),
        F.col("b.consensus_id").alias("baseline_consensus_id"),
        F.col("b.snapshot_t").alias("baseline_t"),
        F.col("b.status").alias("baseline_status"),
        F.col("b.outcomes").alias("baseline_outcomes"),
    )


def _after_signal(trace: DataFrame, sig: DataFrame, base: DataFrame) -> DataFrame:
    """Observations of the baseline market from the signal on, with their distance to the baseline."""
    anchors = base.join(sig.select("fixture_id", "signal_t"), "fixture_id")
    obs = trace.select("market_id", "event_id", "snapshot_t", "status", "outcomes")
    joined = anchors.join(obs, "market_id").filter("snapshot_t >= signal_t")
    both = (F.col("baseline_status") == "ready") & (F.col("status") == "ready")
    return joined.withColumn("delta", F.when(both, max_delta(F.col("baseline_outcomes"), F.col("outcomes"))))


def first_move(trace: DataFrame, sig: DataFrame, base: DataFrame, config: EvaluationConfig) -> DataFrame:
    moved = _after_signal(trace, sig, base).filter(F.col("delta") >= config.material_move_threshold_micros)
    first = F.min(_obs_order())
    return moved.groupBy("fixture_id").agg(first.alias("m")).select(
        "fixture_id", F.col("m.t").alias("move_t"), F.col("m.id").alias("move_event_id")
    )


def _over_windows(
    obs: DataFrame, keys: list[str], values: dict[str, tuple[str, Column]], window_ms: int, block_ms: int
) -> DataFrame:
    """Minima and maxima (``values``: name to kind and column) over [t, t + window] from each material observation.

    ``obs``: fixture_id, ``keys``, snapshot_t, material and further columns, one result row for each
    distinct material one.  Blocks are as long as the window.  Each observation is a row of its own
    block, and a material one also asks the next block how far it had come when its window ends.
    """
    given = [c for c in obs.columns if c != "material"]
    block = div(F.col("snapshot_t") - F.pmod("snapshot_t", F.lit(block_ms)), block_ms)
    here = obs.select("*", block.alias("__block"), F.col("snapshot_t").alias("__at"), F.lit(False).alias("__asks"))
    asked = here.filter("material").withColumns(
        {"__block": F.col("__block") + 1, "__at": F.col("snapshot_t") + window_ms, "__asks": F.lit(True)}
    )
    if window_ms == 0:  # nothing follows
        asked = asked.limit(0)
    place = Window.partitionBy("fixture_id", *keys, "__block")
    reach = (Window.unboundedPreceding, Window.currentRow)
    rest, begun = place.orderBy(F.desc("__at")).rangeBetween(*reach), place.orderBy("__at").rangeBetween(*reach)
    pick = {"min": F.min, "max": F.max}
    counted = lambda column: F.when(~F.col("__asks"), column)
    both = here.unionByName(asked).withColumns(
        {
            f"__{name}": F.when(F.col("__asks"), pick[kind](counted(column)).over(begun)).otherwise(pick[kind](counted(column)).over(rest))
            for name, (kind, column) in values.items()
        }
    )
    return both.filter("material").groupBy(*given).agg(*[pick[kind](f"__{name}").alias(name) for name, (kind, _) in values.items()])


def convergence(trace: DataFrame, sig: DataFrame, base: DataFrame, config: EvaluationConfig) -> DataFrame:
    """Per fixture: the first material observation that its whole following window agrees with.

    The agreement of a window is decided from the minimum and maximum of each outcome in it,
    so no pairs of observations arise.  Time is cut into blocks as long as the window: a
    window is the rest of its own block and the beginning of the next one, so both parts are
    running values and no window is gone through row by row.
    """
    window_ms, tolerance = config.convergence_window_ms, config.convergence_tolerance_micros
    block_ms = max(window_ms, 1)
    obs = _after_signal(trace, sig, base).withColumns(
        {
            "ids": F.when(F.col("status") == "ready", F.array_join(F.col("outcomes.outcome_id"), "|")),
            "material": F.coalesce(F.col("delta") >= config.material_move_threshold_micros, F.lit(False)),
        }
    )
    seen = ["ids", "snapshot_t"]
    framed = (
        _over_windows(obs.select("fixture_id", "event_id", "material", *seen), [], {
            "first_ids": ("min", F.col("ids")),
            "last_ids": ("max", F.col("ids")),
            "unready": ("max", F.col("ids").isNull()),
            "window_end_t": ("max", F.col("snapshot_t")),
        }, window_ms, block_ms)
        .filter((F.col("first_ids") == F.col("last_ids")) & ~F.col("unready"))
        .select("fixture_id", "event_id", "snapshot_t", "window_end_t")
    )
    per_outcome = obs.select("fixture_id", "event_id", "material", "snapshot_t", F.explode("outcomes").alias("o")).select(
        "fixture_id", "event_id", "material", "snapshot_t", "o.outcome_id", F.col("o.probability_micros").alias("p")
    )
    p = F.col("p")
    spread = _over_windows(per_outcome, ["outcome_id"], {"low": ("min", p), "high": ("max", p)}, window_ms, block_ms)
    gap = F.max(F.greatest(F.col("high") - p, p - F.col("low"))).alias("gap")
    gaps = spread.groupBy("fixture_id", "event_id").agg(gap)
    last_seen = obs.groupBy("fixture_id").agg(F.max("snapshot_t").alias("last_t"))
    own = obs.filter("material").select("fixture_id", "event_id", "snapshot_t", "outcomes")
    end = F.col("snapshot_t") + window_ms
    covered = F.col("window_end_t") == end if config.coverage == "exact" else F.col("last_t") >= end
    stable = (
        own.join(framed, ["fixture_id", "event_id", "snapshot_t"])
        .join(gaps, ["fixture_id", "event_id"])
        .join(last_seen, "fixture_id")
        .filter(covered & (F.col("gap") <= tolerance))
    )
    first = F.min_by(F.struct("snapshot_t", "event_id", "outcomes"), _obs_order())
    return stable.groupBy("fixture_id").agg(first.alias("c")).select(
        "fixture_id",
        F.col("c.snapshot_t").alias("convergence_t"),
        F.col("c.event_id").alias("convergence_event_id"),
        F.col("c.outcomes").alias("converged_outcomes"),
    )


def latencies(events: DataFrame, sig: DataFrame, base: DataFrame, config: EvaluationConfig) -> DataFrame:
    """Reaction latency of every bookmaker of the baseline market of each fixture."""
    anchors = base.join(sig, "fixture_id").select(
        F.col("fixture_id").alias("signal_id"), "market_id", "signal_t", "baseline_status", "baseline_outcomes"
    )
    measured = reaction_latency(anchors, quote_vectors(events), config.material_move_threshold_micros)
    return measured.withColumnRenamed("signal_id", "fixture_id")


def _decision_order() -> Column:
    return F.struct(
        F.col("logical_timestamp_ms").alias("t"), F.col("expected_state_version").alias("v"), F.col("decision_id").alias("id")
    )


def lifecycle(decisions: DataFrame, sig: DataFrame, ends: DataFrame) -> DataFrame:
    """Per (fixture, policy): first pause after the signal, its exit, the reopening, durations.

    ``ends``: fixture_id, end_t.  `pause_duration_ms` is the first interval; `pause_total_ms`
    adds up every PAUSED interval of every market.
    """
    keys = ["fixture_id", "policy_id"]
    after = decisions.join(sig.select("fixture_id", "signal_t"), "fixture_id").filter("logical_timestamp_ms >= signal_t")
    paused = (
        after.filter("next_state = 'PAUSED'")
        .groupBy(*keys)
        .agg(F.min(_decision_order()).alias("p"))
        .select(*keys, F.col("p.t").alias("paused_t"), F.col("p.id").alias("paused_decision_id"))
    )
    later = decisions.join(paused, keys).filter("logical_timestamp_ms > paused_t")
    reopening = (F.col("previous_state") != "OPEN") & (F.col("next_state") == "OPEN")
    exits = later.groupBy(*keys).agg(
        F.min(F.when(F.col("next_state") != "PAUSED", F.col("logical_timestamp_ms"))).alias("exit_t"),
        F.min(F.when(reopening, _decision_order())).alias("r"),
    )
    following = decisions.select(
        "policy_id", "market_id", (F.col("expected_state_version") - 1).alias("expected_state_version"),
        F.col("logical_timestamp_ms").alias("next_t"),
    )
    in_pause = decisions.filter("next_state = 'PAUSED'").join(
        following, ["policy_id", "market_id", "expected_state_version"], "left"
    )
    totals = (
        in_pause.join(ends, "fixture_id")
        .groupBy(*keys)
        .agg(F.sum(F.coalesce("next_t", "end_t") - F.col("logical_timestamp_ms")).alias("pause_total_ms"))
    )
    return (
        paused.join(exits, keys, "left")
        .join(totals, keys, "left")
        .join(ends, "fixture_id")
        .select(
            *keys,
            "paused_t",
            "paused_decision_id",
            "exit_t",
            F.col("r.t").alias("reopened_t"),
            F.col("r.id").alias("reopened_decision_id"),
            (F.coalesce("exit_t", "end_t") - F.col("paused_t")).alias("pause_duration_ms"),
            "pause_total_ms",
        )
    )


def transition_counts(decisions: DataFrame) -> DataFrame:
    """State changes per (fixture, policy, from, to)."""
    changed = decisions.filter("next_state <> previous_state")
    return changed.groupBy("fixture_id", "policy_id", "previous_state", "next_state").agg(F.count(F.lit(1)).alias("transitions"))


def transition_summary(counts: DataFrame) -> DataFrame:
    """Totals, flaps (a recovery that falls back) and the counts by ``FROM->TO`` as canonical JSON."""
    flap = (F.col("previous_state") == "RECOVERY") & F.col("next_state").isin("PAUSED", "WIDENED")
    # at most twelve transitions exist, so the list is bounded
    pair = F.concat(F.lit('"'), F.col("previous_state"), F.lit("->"), F.col("next_state"), F.lit('":'), F.col("transitions").cast("string"))
    return counts.groupBy("fixture_id", "policy_id").agg(
        F.sum("transitions").alias("transition_count"),
        F.coalesce(F.sum(F.when(flap, F.col("transitions"))), F.lit(0)).alias("flap_count"),
        F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list(pair)), ","), F.lit("}")).alias("transition_json"),
    )


def control_window(decisions: DataFrame, sig: DataFrame, base: DataFrame) -> DataFrame:
    """Normal play between baseline and signal: decisions and restrictive changes per policy."""
    span = base.select("fixture_id", "baseline_t").join(sig.select("fixture_id", "signal_t"), "fixture_id")
    inside = decisions.join(span, "fixture_id").filter("logical_timestamp_ms >= baseline_t AND logical_timestamp_ms < signal_t")
    restrictive = (F.col("next_state") != F.col("previous_state")) & (F.col("next_state") != "OPEN")
    return inside.groupBy("fixture_id", "policy_id").agg(
        F.count(F.lit(1)).alias("control_decisions"), F.count_if(restrictive).alias("control_restrictive")
    )


def false_pause(events: DataFrame, sig: DataFrame) -> DataFrame:
    """Was the signal confirmed, overturned later, or left open?  One of four labels per fixture."""
    reversals = classify_scores(events).filter("confirmation = 'reversal' OR kind = 'var_overturned'")
    last = reversals.groupBy("fixture_id").agg(F.max("source_timestamp_ms").alias("last_reversal_t"))
    fixtures = events.select("fixture_id").distinct()
    joined = fixtures.join(sig, "fixture_id", "left").join(last, "fixture_id", "left")
    label = (
        F.when(F.col("signal_event_id").isNull(), F.lit("no_protective_signal"))
        .when(F.col("signal_confirmation") == "confirmed", F.lit("confirmed_signal"))
        .when(F.col("last_reversal_t") > F.col("signal_t"), F.lit("overturned_signal"))
        .otherwise(F.lit("indeterminate_unconfirmed"))
    )
    return joined.select("fixture_id", label.alias("false_pause_status"))


def probe_orders(
    events: DataFrame,
    decisions: DataFrame,
    sig: DataFrame,
    outcome_id: str | None = None,
    delay_ms: int = 3_000,
    idempotency_key: str = "evaluation-paused-order",
    namespace: str = "replay:evaluation",
    price: int = 2_400,
    stake_micros: int = 1_000_000,
) -> DataFrame:
    """A sample order per (fixture, policy) shortly after the signal, rejected while PAUSED.

    It is priced from the fixture's last normalized quote before the signal; ``outcome_id``
    picks the outcome (default: the first of the vector).
    """
    keys = ["fixture_id", "policy_id"]
    quotes = quote_vectors(events).join(sig.select("fixture_id", "signal_t"), "fixture_id").filter("observed_at_ms < signal_t")
    last = quotes.groupBy("fixture_id").agg(F.max_by(F.struct("market_id", "bookmaker_id", "event_id", "observed_at_ms", "outcomes"), "ord").alias("q"))
    vector = normalize_vectors(last.select("fixture_id", "q.*")).filter("code IS NULL")
    chosen = F.expr("vector[0]") if outcome_id is None else F.expr(f"get(filter(vector, o -> o.outcome_id = {cj.literal(outcome_id)}), 0)")
    priced = vector.select("fixture_id", chosen.alias("o")).select(
        "fixture_id", F.col("o.outcome_id").alias("outcome_id"), F.col("o.probability_micros").alias("requested_probability_micros")
    )
    after = decisions.join(sig.select("fixture_id", "signal_t"), "fixture_id").filter("logical_timestamp_ms >= signal_t AND next_state = 'PAUSED'")
    paused = after.groupBy(*keys).agg(
        F.min_by(F.struct("decision_id", "expected_state_version", "market_id", "signal_t"), _decision_order()).alias("d")
    )
    requests = paused.join(priced, "fixture_id").select(
        *keys,
        F.col("d.decision_id").alias("expected_decision_id"),
        (F.col("d.expected_state_version") + 1).alias("expected_state_version"),
        F.lit(idempotency_key).alias("idempotency_key"),
        F.col("d.market_id").alias("market_id"),
        F.lit(namespace).alias("namespace"),
        "outcome_id",
        F.lit(price).cast("long").alias("price"),
        (F.col("d.signal_t") + delay_ms).alias("quote_observed_at_ms"),
        (F.col("d.signal_t") + delay_ms).alias("requested_at_ms"),
        F.lit("back").alias("side"),
        F.lit(stake_micros).cast("long").alias("stake_micros"),
        "requested_probability_micros",
    )
    return order_ids(requests)


def error_proxy(rejected: DataFrame, converged: DataFrame) -> DataFrame:
    """Distance between the price of rejected orders and the converged probability."""
    probability = F.expr("get(filter(converged_outcomes, o -> o.outcome_id = outcome_id), 0).probability_micros")
    joined = rejected.join(converged.select("fixture_id", "converged_outcomes"), "fixture_id", "left")
    error = F.abs(probability - F.col("requested_probability_micros"))
    measured = joined.withColumn("error", error)
    totals = measured.groupBy("fixture_id", "policy_id").agg(
        F.count(F.lit(1)).alias("rejected_orders"),
        F.count("error").alias("evaluated_orders"),
        F.max("error").alias("max_error_micros"),
        F.sum("error").alias("__sum"),
    )
    return totals.withColumn("mean_error_micros", mean_rounded(F.col("__sum"), F.col("evaluated_orders"))).drop("__sum")


def report_facts(
    events: DataFrame,
    trace: DataFrame,
    decisions: DataFrame,
    config: EvaluationConfig,
    rejected: DataFrame | None = None,
    with_latencies: bool = True,
) -> DataFrame:
    """Every diagnostic and metric, one row per (fixture, policy) that has decisions."""
    # one row per fixture each, and read by almost every step below
    sig = stage(signals(events))
    base = stage(baseline(trace, sig))
    move = first_move(trace, sig, base, config)
    conv = stage(convergence(trace, sig, base, config))
    ends = events.groupBy("fixture_id").agg(F.max("source_timestamp_ms").alias("end_t"))
    keys = ["fixture_id", "policy_id"]
    last = F.max_by("next_state", "ord").alias("last_state")
    rows = decisions.groupBy(*keys).agg(
        last,
        F.count(F.lit(1)).alias("decision_count"),
        F.min("policy_configuration_hash").alias("policy_configuration_hash"),
        F.min("policy_version").alias("policy_version"),
    )
    facts = (
        rows.join(sig, "fixture_id", "left")
        .join(base.drop("market_id", "baseline_outcomes"), "fixture_id", "left")
        .join(move, "fixture_id", "left")
        .join(conv.drop("converged_outcomes"), "fixture_id", "left")
        .join(false_pause(events, sig), "fixture_id", "left")
        .join(lifecycle(decisions, sig, ends), keys, "left")
        .join(transition_summary(transition_counts(decisions)), keys, "left")
        .join(control_window(decisions, sig, base), keys, "left")
    )
    if with_latencies:
        lat = latencies(events, sig, base, config)
        item = F.struct("bookmaker_id", "first_reaction_event_id", "latency_ms")
        per_fixture = lat.groupBy("fixture_id").agg(
            F.max("latency_ms").alias("max_reaction_ms"),
            F.sort_array(F.collect_list(F.when(F.col("status") == "measured", item))).alias("reactions"),
        )
        facts = facts.join(per_fixture, "fixture_id", "left")
    else:
        facts = facts.withColumn("max_reaction_ms", F.lit(None).cast("long")).withColumn(
            "reactions", F.expr("cast(NULL AS ARRAY<STRUCT<bookmaker_id: STRING, first_reaction_event_id: STRING, latency_ms: BIGINT>>)")
        )
    if rejected is not None:
        facts = facts.join(error_proxy(rejected, conv), keys, "left")
    else:
        facts = facts.withColumns({c: F.lit(None).cast("long") for c in ("rejected_orders", "evaluated_orders", "max_error_micros", "mean_error_micros")})
    zero = ["transition_count", "flap_count", "control_decisions", "control_restrictive", "signal_count", "rejected_orders", "evaluated_orders"]
    filled = facts.fillna(0, zero).fillna("{}", ["transition_json"])
    return filled.withColumns(
        {
            "move_latency_ms": F.col("move_t") - F.col("signal_t"),
            "reopen_latency_ms": F.col("reopened_t") - F.col("signal_t"),
            "control_duration_ms": F.col("signal_t") - F.col("baseline_t"),
            "overlong_pause_ms": F.when(
                F.col("exit_t").isNotNull() & F.col("convergence_t").isNotNull(),
                F.greatest(F.lit(0), F.col("exit_t") - F.col("convergence_t") - config.overlong_pause_grace_ms),
            ),
            "final_state": F.when(F.col("reopened_t").isNotNull(), F.lit("OPEN")).otherwise(F.col("last_state")),
        }
    )


def timeline(facts: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """Up to seven kinds of milestones per (fixture, policy), ordered by (time, id) when read."""
    kinds = (
        ("normal_control_started", "baseline_t", "baseline_consensus_id"),
        ("protective_signal", "signal_t", "signal_event_id"),
        ("market_paused", "paused_t", "paused_decision_id"),
        ("consensus_moved", "move_t", "move_event_id"),
        ("consensus_converged", "convergence_t", "convergence_event_id"),
        ("market_reopened", "reopened_t", "reopened_decision_id"),
    )

    def entry(position: int, kind: str, at: str, key: str) -> Column:
        label = F.concat("signal_kind", F.lit(" signal observed.")) if kind == "protective_signal" else F.lit(TIMELINE_LABELS[kind])
        row = F.struct(
            F.col(at).alias("at_ms"), F.col(key).alias("event_id"), F.lit(position).alias("position"), F.lit(kind).alias("kind"),
            label.alias("label"),
        )
        return F.when(F.col(at).isNotNull(), row)

    entries = F.array_compact(F.array(*[entry(i, *k) for i, k in enumerate(kinds)]))
    rows = facts.select("fixture_id", "policy_id", F.explode(entries).alias("e")).select("fixture_id", "policy_id", "e.*")
    if rejected is None:
        return rows
    orders = rejected.select(
        "fixture_id", "policy_id", F.col("requested_at_ms").alias("at_ms"), F.col("order_id").alias("event_id"),
        F.lit(len(kinds)).alias("position"), F.lit("paper_order_rejected").alias("kind"),
        F.lit(TIMELINE_LABELS["paper_order_rejected"]).alias("label"),
    )
    return rows.unionByName(orders)


def _report_json(config: EvaluationConfig, data_mode: str, policies: dict[str, RiskPolicy]) -> str:
    arms = " ".join(f"WHEN policy_id = {cj.literal(n)} THEN {cj.literal(canonical_text(p.as_json()))}" for n, p in policies.items())
    entry = cj.obj({"atMs": cj.scalar("e.at_ms"), "eventId": cj.text("e.event_id"), "kind": cj.plain("e.kind"), "label": cj.text("e.label")})
    reaction = cj.obj(
        {
            "bookmakerId": cj.text("r.bookmaker_id"),
            "firstReactionEventId": cj.text("r.first_reaction_event_id"),
            "latencyMs": cj.scalar("r.latency_ms"),
        }
    )
    return cj.obj(
        {
            "dataMode": cj.plain(cj.literal(data_mode)),
            "diagnostics": cj.obj(
                {
                    "convergenceAtMs": cj.scalar("convergence_t"),
                    "falsePauseStatus": cj.plain("false_pause_status"),
                    "firstMaterialMoveEventId": cj.text("move_event_id"),
                    "overlongPauseMs": cj.scalar("overlong_pause_ms"),
                    "pausedAtMs": cj.scalar("paused_t"),
                    "reopenedAtMs": cj.scalar("reopened_t"),
                    "signalEventId": cj.text("signal_event_id"),
                    "signalKind": cj.plain("signal_kind"),
                }
            ),
            "evaluationVersion": cj.plain(cj.literal(config.evaluation_version)),
            "fixtureId": cj.text("fixture_id"),
            "generatedFrom": cj.obj(
                {
                    "eventSequenceHash": cj.plain("event_sequence_hash"),
                    "inputHash": cj.plain("input_hash"),
                    "manifestId": cj.plain("manifest_id"),
                    "strategyHash": cj.plain("strategy_hash"),
                }
            ),
            "limitations": "'[" + ",".join(f'"{x}"' for x in LIMITATIONS) + "]'",
            "metrics": cj.obj(
                {
                    "avoidedPriceErrorProxy": cj.obj(
                        {
                            "evaluatedOrderCount": cj.scalar("evaluated_orders"),
                            "label": cj.plain(cj.literal(PROXY_LABEL)),
                            "maxErrorMicros": cj.scalar("max_error_micros"),
                            "meanErrorMicros": cj.scalar("mean_error_micros"),
                            "rejectedOrderCount": cj.scalar("rejected_orders"),
                        }
                    ),
                    "bookmakerReactionLatencies": f"coalesce({cj.items('reactions', 'r', reaction)}, '[]')",
                    "eventToFirstConsensusMoveLatencyMs": cj.scalar("move_latency_ms"),
                    "flappingCount": cj.scalar("flap_count"),
                    "maxBookmakerReactionLatencyMs": cj.scalar("max_reaction_ms"),
                    "normalPlayControl": cj.obj(
                        {
                            "decisionCount": cj.scalar("control_decisions"),
                            "durationMs": cj.scalar("control_duration_ms"),
                            "restrictiveTransitionCount": cj.scalar("control_restrictive"),
                        }
                    ),
                    "pauseDurationMs": cj.scalar("pause_duration_ms"),
                    "protectiveSignalCount": cj.scalar("signal_count"),
                    "staleExposureDurationMs": cj.scalar("move_latency_ms"),
                    "stateTransitionCount": cj.scalar("transition_count"),
                    "stateTransitionCounts": "transition_json",
                    "timeToReopenMs": cj.scalar("reopen_latency_ms"),
                }
            ),
            "parameters": cj.literal(canonical_text(config.as_json())),
            "policy": cj.obj(
                {
                    "configuration": f"CASE {arms} END",
                    "configurationHash": cj.plain("policy_configuration_hash"),
                    "version": cj.text("policy_version"),
                }
            ),
            "sensitivity": "sensitivity_json",
            "timeline": f"coalesce({cj.items('milestones', 'e', entry)}, '[]')",
        }
    )


def evaluate(
    events: DataFrame,
    trace: DataFrame,
    decisions: DataFrame,
    manifest_rows: DataFrame,
    policies: dict[str, RiskPolicy],
    config: EvaluationConfig = EvaluationConfig(),
    rejected: DataFrame | None = None,
    base_policy: str | None = None,
    changes: dict[str, dict[str, int]] | None = None,
    data_mode: str = "historical",
) -> DataFrame:
    """Hash-addressed report per (fixture, policy).

    With ``base_policy`` the reports of that policy also list, under sensitivity, the outcome
    of every other policy with its ``changes``.
    """
    keys = ["fixture_id", "policy_id"]
    facts = report_facts(events, trace, decisions, config, rejected)
    entry = F.struct("at_ms", "event_id", "position", "kind", "label")
    milestones = timeline(facts, rejected).groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("milestones"))
    provenance = manifest_rows.select("fixture_id", "manifest_id", "event_sequence_hash", "input_hash", "strategy_hash")
    rows = facts.join(milestones, keys, "left").join(provenance, "fixture_id")
    report = _report_json(config, data_mode, policies)

    def hashed(df: DataFrame) -> DataFrame:
        return df.withColumn("report_json", F.expr(report)).withColumn("evaluation_hash", F.sha2("report_json", 256))

    alone = hashed(rows.withColumn("sensitivity_json", F.lit("[]")))
    if base_policy is None:
        return alone
    changed = changes or {}
    arms = " ".join(f"WHEN policy_id = {cj.literal(n)} THEN {cj.literal(canonical_text(changed.get(n, {})))}" for n in policies)
    variant = cj.obj(
        {
            "changedParameters": f"CASE {arms} END",
            "evaluationHash": cj.plain("evaluation_hash"),
            "finalState": cj.plain("final_state"),
            "flappingCount": cj.scalar("flap_count"),
            "label": cj.text("policy_id"),
            "pauseDurationMs": cj.scalar("pause_duration_ms"),
            "timeToReopenMs": cj.scalar("reopen_latency_ms"),
        }
    )
    variants = alone.filter(F.col("policy_id") != base_policy)
    listed = variants.groupBy("fixture_id").agg(
        F.sort_array(F.collect_list(F.struct("policy_id", F.expr(variant).alias("j")))).alias("v")
    )
    listed = listed.select("fixture_id", F.expr("concat('[', array_join(v.j, ','), ']')").alias("sensitivity_json"))
    base_rows = rows.filter(F.col("policy_id") == base_policy).join(listed, "fixture_id", "left").fillna("[]", ["sensitivity_json"])
    return hashed(base_rows).unionByName(variants)


def report_violations(reports: DataFrame) -> DataFrame:
    """Stored reports whose hash does not match their content."""
    return reports.filter(F.col("evaluation_hash") != F.sha2("report_json", 256)).select("evaluation_hash")


def report_summary(reports: DataFrame) -> DataFrame:
    """Readable columns: probability points with one decimal, milliseconds as text."""
    def points(column: str) -> str:
        return f"CASE WHEN {column} IS NULL THEN 'not evaluable' ELSE concat(format_string('%.1f', cast({column} AS decimal(20,1)) / 10000), ' pp') END"

    def ms(column: str) -> str:
        return f"CASE WHEN {column} IS NULL THEN 'not observed' ELSE concat(format_number({column}, 0), ' ms') END"

    return reports.selectExpr(
        "fixture_id",
        "policy_id",
        f"{ms('move_latency_ms')} AS first_move",
        f"{ms('pause_duration_ms')} AS pause_duration",
        f"{ms('reopen_latency_ms')} AS time_to_reopen",
        f"{ms('control_duration_ms')} AS control_window",
        f"{points('mean_error_micros')} AS mean_price_error",
        f"{points('max_error_micros')} AS max_price_error",
        "final_state",
        "flap_count",
    )
