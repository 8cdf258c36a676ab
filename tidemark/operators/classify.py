"""Classification of match events into protective signals, as one expression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.staging import fence

# --- fixed values -----------------------------------------------------------------
# Each rule: action, condition, kind, reason, protective action, severity, confirmation.
# The first matching rule wins.  A condition names a test of `_tests`; a
# confirmation of None keeps the event's own.
RULES = (
    ("possible", "possible_goal", "possible_goal", "EVENT_POSSIBLE_GOAL", "pause", "critical", "unconfirmed"),
    ("possible", "possible_penalty", "possible_penalty", "EVENT_POSSIBLE_PENALTY", "pause", "critical", "unconfirmed"),
    ("possible", "possible_red_card", "possible_red_card", "EVENT_POSSIBLE_RED_CARD", "pause", "critical", "unconfirmed"),
    ("possible", "possible_review", "possible_var", "EVENT_POSSIBLE_VAR", "pause", "critical", "unconfirmed"),
    ("goal", "unconfirmed", "goal", "EVENT_GOAL_UNCONFIRMED", "pause", "critical", None),
    ("goal", None, "goal", "EVENT_GOAL", "pause", "critical", None),
    ("penalty", "unconfirmed", "penalty", "EVENT_PENALTY_UNCONFIRMED", "pause", "critical", None),
    ("penalty", None, "penalty", "EVENT_PENALTY", "pause", "critical", None),
    ("penalty_outcome", "outcome_scored", "penalty_scored", "EVENT_PENALTY_SCORED", "pause", "critical", None),
    ("penalty_outcome", "outcome_missed", "penalty_missed", "EVENT_PENALTY_MISSED", "pause", "high", None),
    ("penalty_outcome", "outcome_retake", "penalty", "EVENT_PENALTY_RETAKE", "pause", "critical", None),
    ("penalty_outcome", None, "penalty", "EVENT_PENALTY_OUTCOME", "pause", "critical", None),
    ("red_card", "unconfirmed", "red_card", "EVENT_RED_CARD_UNCONFIRMED", "pause", "critical", None),
    ("red_card", None, "red_card", "EVENT_RED_CARD", "pause", "critical", None),
    ("var", "review_cornerkick", "var_started", "EVENT_VAR_CORNER_KICK", "pause", "critical", None),
    ("var", "review_goal", "var_started", "EVENT_VAR_GOAL", "pause", "critical", None),
    ("var", "review_mistakenidentity", "var_started", "EVENT_VAR_MISTAKEN_IDENTITY", "pause", "critical", None),
    ("var", "review_other", "var_started", "EVENT_VAR_OTHER", "pause", "critical", None),
    ("var", "review_penalty", "var_started", "EVENT_VAR_PENALTY", "pause", "critical", None),
    ("var", "review_redcard", "var_started", "EVENT_VAR_RED_CARD", "pause", "critical", None),
    ("var", "review_secondyellowcard", "var_started", "EVENT_VAR_SECOND_YELLOW_CARD", "pause", "critical", None),
    ("var", None, "var_started", "EVENT_VAR_REVIEW", "pause", "critical", None),
    ("var_end", "outcome_overturned", "var_overturned", "EVENT_VAR_OVERTURNED", "pause", "high", "reversal"),
    ("var_end", "outcome_stands", "var_stands", "EVENT_VAR_STANDS", "pause", "high", None),
    ("var_end", None, "var_stands", "EVENT_VAR_ENDED", "pause", "high", None),
    ("action_discarded", None, "action_discarded", "EVENT_ACTION_DISCARDED", "pause", "high", "reversal"),
    ("action_amend", None, "action_amended", "EVENT_ACTION_AMENDED", "pause", "high", "amendment"),
    ("score_adjustment", None, "score_adjusted", "EVENT_SCORE_ADJUSTMENT", "pause", "critical", "confirmed"),
    ("suspend", "reliable", "coverage_recovered", "FEED_RELIABILITY_RESTORED", "none", "low", "confirmed"),
    ("suspend", None, "coverage_unreliable", "FEED_UNRELIABLE", "pause", "critical", "confirmed"),
    ("disconnected", None, "coverage_unreliable", "SCOUT_DISCONNECTED", "pause", "critical", None),
    ("game_finalised", None, "match_finalised", "MATCH_FINALISED", "pause", "critical", "confirmed"),
    ("status", "unsafe_phase", "phase_unsafe", "MATCH_PHASE_UNSAFE", "pause", "critical", None),
    ("status", None, "phase_change", "MATCH_PHASE_CHANGED", "widen", "low", None),
)
NORMAL = ("normal", "SCORE_EVENT_NORMAL", "none", "none", "not_applicable")
UNSAFE_PHASES = (14, 15, 16, 17, 18, 19)
REVIEW_TYPES = ("cornerkick", "goal", "mistakenidentity", "other", "penalty", "redcard", "secondyellowcard")
OUTCOMES = ("scored", "missed", "retake", "overturned", "stands")
# ----------------------------------------------------------------------------------

SIGNAL_FIELDS = ("kind", "reason_code", "protective_action", "severity", "confirmation")


def canonical_action(v: str) -> str:
    """Trimmed, lower-cased, with runs of white space and hyphens as one underscore."""
    trimmed = rf"regexp_replace({v}, r'(?U)^[\s\x{{FEFF}}]+|[\s\x{{FEFF}}]+$', '')"
    return rf"regexp_replace(lower({trimmed}), r'(?U)[\s\x{{FEFF}}-]+', '_')"


def _tests(score: str, details: str, own: str) -> dict[str, str]:
    tests = {
        "possible_goal": f"{details}.possible.goal",
        "possible_penalty": f"{details}.possible.penalty",
        "possible_red_card": f"{details}.possible.red_card",
        "possible_review": f"{details}.possible.review",
        "unconfirmed": f"{own} = 'unconfirmed'",
        "reliable": f"{details}.reliable",
        "unsafe_phase": f"{score}.status_id IN {UNSAFE_PHASES}",
    }
    tests |= {f"outcome_{o}": f"lower({details}.outcome) = '{o}'" for o in OUTCOMES}
    tests |= {f"review_{r}": f"{canonical_action(details + '.review_type')} = '{r}'" for r in REVIEW_TYPES}
    return tests


def score_signal(score: str = "score", version: str = "payload_version") -> str:
    """Signal struct of one score payload; payload version 1 carries no details."""
    details = f"(CASE WHEN {version} = 2 THEN {score}.details END)"
    own = f"""(CASE WHEN {version} <> 2 OR {score}.confirmed IS NULL THEN 'unknown'
        WHEN {score}.confirmed THEN 'confirmed' ELSE 'unconfirmed' END)"""
    tests = _tests(score, details, own)

    def result(*values) -> str:
        named = [f"'{n}', {own if v is None else repr(v)}" for n, v in zip(SIGNAL_FIELDS, values)]
        return f"named_struct({', '.join(named)})"

    arms = []
    for name, condition, *outcome in RULES:
        test = f"a = '{name}'" + ("" if condition is None else f" AND {tests[condition]}")
        arms.append(f"WHEN {test} THEN {result(*outcome)}")
    chain = f"CASE {' '.join(arms)} ELSE {result(*NORMAL)} END"
    return f"transform(array({canonical_action(score + '.action')}), a -> {chain})[0]"


def classify_scores(events: DataFrame) -> DataFrame:
    """Score events with their classification."""
    scored = events.filter(F.col("kind") == "score.observed")
    return fence(scored.withColumn("signal", F.expr(score_signal()))).select(
        "fixture_id",
        "event_id",
        "source_timestamp_ms",
        "sequence",
        "source_priority",
        "source_id",
        "idempotency_key",
        F.col("score.action").alias("action"),
        *[F.col(f"signal.{n}").alias(n) for n in SIGNAL_FIELDS],
    )
