"""Classifier cases, the fold against a row-by-row fold, restart and audits."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.config import LEGAL_TRANSITIONS, STATES, RiskPolicy
from tidemark.operators import consensus as con
from tidemark.operators import risk
from tidemark.operators.classify import classify_scores
from tidemark.schemas import EVENTS_DDL, schema
from tidemark.sources import sample_feed as feed

SF = "/root/testdata/sf0.001"


def score(action, confirmed=None, status=None, possible=(None,) * 4, outcome=None, reliable=None, review=None, version=2):
    details = (None, outcome, possible, None, reliable, review)
    payload = ("f", action, None, None, None, [], status, "1", confirmed, details)
    return ("e", "k", "f", "score.observed", version, "live", "f:1", 30, 1, 1, 1, None, None, payload)


CASES = [
    (score("possible", possible=(True, None, None, None)), "possible_goal", "pause", "unconfirmed"),
    (score("possible", possible=(False, True, None, None)), "possible_penalty", "pause", "unconfirmed"),
    (score("possible", possible=(None, None, None, True)), "possible_var", "pause", "unconfirmed"),
    (score("possible"), "normal", "none", "not_applicable"),
    (score(" Goal ", confirmed=False), "goal", "pause", "unconfirmed"),
    (score("Red-Card", confirmed=True), "red_card", "pause", "confirmed"),
    (score("penalty outcome", outcome="MISSED"), "penalty_missed", "pause", "unknown"),
    (score("var_end", outcome="Overturned"), "var_overturned", "pause", "reversal"),
    (score("action_amend"), "action_amended", "pause", "amendment"),
    (score("suspend", reliable=True), "coverage_recovered", "none", "confirmed"),
    (score("suspend"), "coverage_unreliable", "pause", "confirmed"),
    (score("status", status=14), "phase_unsafe", "pause", "unknown"),
    (score("status", status=3), "phase_change", "widen", "unknown"),
    (score("game_finalised"), "match_finalised", "pause", "confirmed"),
    (score("goal", confirmed=True, version=1), "goal", "pause", "unknown"),
    (score("throw_in"), "normal", "none", "not_applicable"),
]


def test_classifier_cases(spark):
    rows = [(str(i), *c[0][1:]) for i, c in enumerate(CASES)]
    found = {int(r.event_id): r for r in classify_scores(spark.createDataFrame(rows, schema(EVENTS_DDL))).collect()}
    for i, (_, kind, action, confirmation) in enumerate(CASES):
        assert (found[i].kind, found[i].protective_action, found[i].confirmation) == (kind, action, confirmation), i


@pytest.fixture(scope="module")
def inputs(spark):
    events = feed.events(spark, SF)
    return risk.risk_inputs(events, con.consensus_trace(events, feed.CONSENSUS), feed.CONSENSUS)


def fold_row_by_row(rows, p: RiskPolicy):
    """The policy applied one row after another, per market."""
    state, out = {}, {}
    for r in rows:
        s, change, n, shock = state.get(r.market_id, ("OPEN", r.t, 0, 0))
        if r.reversal:
            shock = r.t + p.reversal_shock_hold_ms
        elif r.pause_signal:
            shock = max(shock, r.t + p.critical_shock_hold_ms)
        pause, after, m = r.pause_signal or r.market_pause or shock > r.t, s, n
        if pause:
            after, m = "PAUSED", 0
        elif s == "OPEN" and r.widen:
            after, m = "WIDENED", 0
        elif s == "WIDENED" and r.healthy and r.t - change >= p.minimum_widened_ms:
            after, m = "RECOVERY", 1
        elif s == "PAUSED":
            after, m = ("RECOVERY", 1) if r.healthy and r.t - change >= p.minimum_pause_ms else (s, 0)
        elif s == "RECOVERY":
            m = n + 1 if r.healthy else 0
            if r.healthy and m >= p.recovery_stable_updates and r.t - change >= p.recovery_cooldown_ms:
                after, m = "OPEN", 0
        change = r.t if after != s else change
        state[r.market_id] = (after, change, m, shock)
        out[(r.market_id, r.event_id)] = (s, after, m, change, shock)
    return out


@pytest.mark.parametrize("policy", [feed.POLICY, feed.POLICY.but(minimum_pause_ms=40_000_000, critical_shock_hold_ms=1_000)])
def test_parallel_fold_equals_row_by_row(inputs, policy):
    rows = risk.fold_inputs(inputs, {"p": policy}).orderBy("t", "sequence", "source_id").collect()
    want = fold_row_by_row(rows, policy)
    got = {
        (r.market_id, r.trigger_event_id): (
            r.previous_state, r.next_state, r.metrics.recovery_stable_updates, r.metrics.last_state_change_at_ms, r.metrics.shock_until_ms,
        )
        for r in risk.decide(inputs, {"p": policy}).collect()
    }
    assert len(want) > 900 and got == want


def test_fold_does_not_depend_on_chunks(inputs):
    one = risk.decide(inputs, {"p": feed.POLICY})
    other = risk.decide(inputs.withColumn("chunk", F.lit(0).cast("long")), {"p": feed.POLICY})
    columns = ["decision_id", "input_feature_hash", "next_state", "reason_codes"]
    assert one.select(columns).exceptAll(other.select(columns)).count() == 0


def test_resume_from_decisions_continues_the_fold(inputs):
    whole = risk.decide(inputs, {"p": feed.POLICY}).cache()
    cut = whole.agg(F.percentile("logical_timestamp_ms", 0.5)).head()[0]
    state = risk.state_from_decisions(whole.filter(F.col("logical_timestamp_ms") < cut))
    rest = risk.decide(inputs.filter(F.col("t") >= cut), {"p": feed.POLICY}, initial=state)
    columns = ["decision_id", "expected_state_version", "next_state", "input_feature_hash"]
    want = whole.filter(F.col("logical_timestamp_ms") >= cut).select(columns)
    assert want.count() > 300
    assert want.exceptAll(rest.select(columns)).count() == 0 and rest.count() == want.count()


def test_transition_matrix(spark):
    actions = ("none", "widen", "pause", "begin_recovery", "reopen")
    rows = [(a, b, c) for a in actions for b in STATES for c in STATES]
    df = spark.createDataFrame(rows, "action string, previous_state string, next_state string")
    bad = {tuple(r) for r in risk.illegal_transitions(df).collect()}
    assert len(rows) == 80 and set(rows) - bad == set(LEGAL_TRANSITIONS) and len(LEGAL_TRANSITIONS) == 11


def test_policy_checks():
    with pytest.raises(ValueError):
        RiskPolicy(widen_quote_age_ms=6_000)
    with pytest.raises(ValueError):
        RiskPolicy(recovery_dispersion_micros=30_000)
