"""Known answer of the seeded scenario, for the base policy and three variants."""

from __future__ import annotations

import hashlib

import hashlib
import json

import pytest

from tests.seeded import FIXTURE, T0, seeded_events, seeded_fixtures
from tidemark.config import ConsensusConfig, EvaluationConfig, ReplayConfig, RiskPolicy
from tidemark.operators import consensus, evaluation, provenance
from tidemark.plans.trace import sweep

BASE = RiskPolicy()
POLICIES = {
    "base": BASE,
    "conservative": BASE.but(recovery_stable_updates=4),
    "faster": BASE.but(recovery_stable_updates=2),
    "longer_hold": BASE.but(critical_shock_hold_ms=16_000),
}


def short(prefix: str, value: str) -> str:
    return prefix + hashlib.sha256(value.encode()).hexdigest()[:40]


@pytest.fixture(scope="module")
def events(spark):
    return seeded_events(spark).cache()


@pytest.fixture(scope="module")
def reports(spark, events):
    replay = ReplayConfig(data_mode="seeded-simulation", strategy={"riskPolicy": BASE.as_json()})
    rows = provenance.manifests(events, seeded_fixtures(spark), replay)
    probe = {"outcome_id": "seeded-canada"}
    found = sweep(
        events, rows, ConsensusConfig(), POLICIES, "base", EvaluationConfig(coverage="exact"), None, "seeded-simulation", probe=probe
    )
    return {r.policy_id: r.asDict() for r in found.collect()}


def test_event_and_market_ids(events):
    rows = {r.source_id: r for r in events.collect()}
    assert rows["seed-score-1"].event_id == "evt_85ef45ff02416bafede0a6b548f0a979a9e7ca15"
    assert rows["seed-odds-caught-up"].event_id == "evt_40a53b067b2fed2b6a006e18afcfbbbc540eeb1f"
    assert rows["seed-odds-1"].odds.market.market_id == "mkt_f7adc142145a2ec322b80b115a6e76d6282a9a4c"
    key = '"event|10:simulation|14:score.observed|12:seed-score-1|1:2"'
    assert rows["seed-score-1"].event_id == short("evt_", key)


def test_chunked_hash_is_built_on_the_sequential_one(events):
    plain = provenance.sequence_hash(events).head()
    whole = provenance.chunked_hash(events, chunk_ms=10**15).head()
    assert whole.event_count == plain.event_count
    assert whole.event_sequence_hash == hashlib.sha256(f"[{plain.event_sequence_hash}]".encode()).hexdigest()
    fine = provenance.chunked_hash(events, chunk_ms=1_000).head()
    assert fine.event_count == plain.event_count and fine.input_hash != whole.input_hash
    assert provenance.chunked_hash(events.repartition(5), chunk_ms=10**15).head() == whole


def test_sequence_hash(events):
    row = provenance.sequence_hash(events).head()
    assert (row.fixture_id, row.event_count) == (FIXTURE, 8)
    assert row.event_sequence_hash == "b22d1650e536d245eaf98b8eb065d543b79b27ed0370b159741b2d6859962a1d"


def test_policy_hash():
    assert BASE.configuration_hash == "f807f4f5396190944732aa7f944c0223368546e6f35c01bcf2dceb5f189d441b"


def test_first_consensus_id_and_velocity(events):
    rows = consensus.consensus_trace(events, ConsensusConfig()).orderBy("t").collect()
    assert rows[0].consensus_id == "cns_22fcdd808b97940faf701f791a672eec7b0c9aa1"
    velocities = [max((abs(o.velocity_micros_per_s) for o in r.outcomes if o.velocity_micros_per_s is not None), default=None) for r in rows]
    assert velocities == [None, 0, 40_000, 0, 0, 0]


def test_base_report(reports):
    r = reports["base"]
    assert r["signal_t"] == T0 + 60_000 and r["signal_kind"] == "goal" and r["signal_count"] == 1
    assert r["move_latency_ms"] == 8_000 and r["max_reaction_ms"] == 8_000
    assert (r["pause_duration_ms"], r["reopen_latency_ms"]) == (12_000, 18_000)
    assert (r["transition_count"], r["flap_count"]) == (3, 0)
    assert r["transition_json"] == '{"OPEN->PAUSED":1,"PAUSED->RECOVERY":1,"RECOVERY->OPEN":1}'
    assert (r["control_duration_ms"], r["control_decisions"], r["control_restrictive"]) == (59_000, 1, 0)
    assert (r["mean_error_micros"], r["max_error_micros"], r["rejected_orders"]) == (200_000, 200_000, 1)
    assert r["overlong_pause_ms"] == 0 and r["convergence_t"] == T0 + 68_000
    assert r["false_pause_status"] == "indeterminate_unconfirmed"


def test_sensitivity(reports):
    outcome = {k: (v["final_state"], v["pause_duration_ms"], v["reopen_latency_ms"]) for k, v in reports.items()}
    assert outcome["conservative"] == ("RECOVERY", 12_000, None)
    assert outcome["faster"] == ("OPEN", 12_000, 15_000)
    assert outcome["longer_hold"] == ("RECOVERY", 18_000, None)
    listed = json.loads(reports["base"]["report_json"])["sensitivity"]
    assert [v["label"] for v in listed] == ["conservative", "faster", "longer_hold"]


def test_reports_are_canonical_and_hash_addressed(reports):
    for r in reports.values():
        body = json.loads(r["report_json"])
        text = json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert text == r["report_json"]
        assert hashlib.sha256(text.encode()).hexdigest() == r["evaluation_hash"]


def test_tampered_report_is_found(spark, reports):
    rows = [(r["evaluation_hash"], r["report_json"] + (" " if k == "faster" else "")) for k, r in reports.items()]
    bad = evaluation.report_violations(spark.createDataFrame(rows, "evaluation_hash string, report_json string"))
    assert [r.evaluation_hash for r in bad.collect()] == [reports["faster"]["evaluation_hash"]]
