"""Raw payloads, good and bad, in both score dialects."""

from __future__ import annotations

import json

from tidemark.operators import dedup, projections, receipts
from tidemark.operators import normalize as norm
from tidemark.schemas import RAW_INPUT_DDL

ODDS = {
    "Bookmaker": "Example", "BookmakerId": 7, "FixtureId": 18241006, "GameState": None, "InRunning": True, "MarketParameters": None,
    "MarketPeriod": "full", "MessageId": "m-1", "PriceNames": ["Canada", "Draw", "Japan"], "Prices": [2100, 3300, 2900],
    "Pct": ["52.632", "25.000", "22.368"], "SuperOddsType": "1X2", "Ts": 1_799_999_999_000,
}
UPPER = {
    "Action": "goal", "FixtureId": 5, "Seq": 88, "Ts": 10, "StatusSoccerId": "H2", "Id": 991, "Confirmed": True,
    "Stats": [{"Key": 1, "Period": 0, "Value": 2}, {"key": 2, "period": 0, "value": 1}],
    "Data": {"Outcome": "Overturned", "Type": "Goal"},
}
LOWER = {
    "action": "possible", "fixtureId": 5, "seq": 89, "ts": 11, "stats": {"1001": 1, "2": 1, "1": 2},
    "parti1StateSoccer": {"PossibleEvent": {"Goal": True}}, "parti2StateSoccer": {"PossibleEvent": {"Goal": False, "Penalty": False}},
    "possibleEventSoccer": {"VAR": True}, "dataSoccer": {"RedCard": False},
}
FIXTURE = {
    "Competition": "FIFA World Cup", "CompetitionId": 1, "FixtureId": 5, "GameState": 6, "Participant1": "Canada", "Participant1Id": 10,
    "Participant1IsHome": False, "Participant2": "Japan", "Participant2Id": 20, "StartTime": 100, "Ts": 9,
}


def raw(spark, *rows):
    data = [(kind, version, "live", 1, None, p if isinstance(p, str) else json.dumps(p)) for kind, version, p in rows]
    return spark.createDataFrame(data, RAW_INPUT_DDL)


def test_good_records(spark):
    found = {r.source_id: r for r in norm.normalize(raw(spark, ("odds", None, ODDS), ("score", None, UPPER), ("score", None, LOWER), ("fixture", None, FIXTURE), ("odds", 1, ODDS | {"MessageId": "m-2"}))).collect()}
    assert all(r.quarantine_code is None for r in found.values())
    odds = found["m-1"].odds
    assert [o.reported_probability_micros for o in odds.outcomes] == [526_320, 250_000, 223_680]
    assert odds.bookmaker.id == "7" and odds.market.status == "open"
    assert [o.reported_probability_micros for o in found["m-2"].odds.outcomes] == [None] * 3
    up, low = found["5:88"].score, found["5:89"].score
    assert (up.home_score, up.away_score, up.status_id, up.action_id, up.confirmed) == (2, 1, 4, "991", True)
    assert (up.details.outcome, up.details.review_type) == ("Overturned", "Goal")
    assert [(s.key, s.period, s.value) for s in low.stats] == [(1, 0, 2), (2, 0, 1), (1001, 1, 1)]
    flags = low.details.possible
    assert (flags.goal, flags.penalty, flags.red_card, flags.review) == (True, False, False, True)
    assert low.action_id == "5:89" and low.confirmed is None
    fixture = found["fixture:5:9"].fixture
    assert fixture.status == "cancelled" and [(p.id, p.role) for p in fixture.participants] == [("20", "home"), ("10", "away")]


def test_bad_records(spark):
    rows = [
        ("odds", None, ODDS | {"MessageId": "short", "Prices": [2100]}),
        ("odds", None, ODDS | {"MessageId": "quoted", "BookmakerId": "7"}),
        ("odds", None, ODDS | {"MessageId": "pct", "Pct": ["100.001", "NA", "0.001"]}),
        ("odds", None, ODDS | {"MessageId": "null", "Pct": None}),
        ("odds", 3, ODDS | {"MessageId": "version"}),
        ("weather", None, ODDS | {"MessageId": "kind"}),
        ("weather", 2, ODDS | {"MessageId": "both"}),
        ("score", None, UPPER | {"FixtureId": "not-a-number"}),
        ("score", None, {"action": "goal", "fixtureId": "x"}),
        ("score", None, "not json"),
        ("odds", None, ODDS | {"MessageId": "edges", "Pct": ["0.001", "100.000", "NA"], "Ts": 7.0}),
    ]
    found = norm.normalize(raw(spark, *rows)).collect()
    codes = {r.source_id: r.quarantine_code for r in found}
    assert codes["edges"] is None
    assert {codes[i] for i in ("short", "quoted", "pct", "null")} == {"malformed_payload"}
    assert codes["version"] == codes["both"] == "unsupported_payload_version" and codes["kind"] == "unknown_payload_kind"
    loose = [r for r in found if r.payload_kind == "score"]
    assert all(r.quarantine_code == "malformed_payload" and r.source_id.startswith("sha256:") for r in loose)
    edges = next(r for r in found if r.source_id == "edges")
    assert [o.reported_probability_micros for o in edges.odds.outcomes] == [10, 1_000_000, None]


def test_append_labels(spark):
    rows = [
        ("odds", None, ODDS), ("odds", None, ODDS), ("odds", None, ODDS | {"Prices": [1, 2, 3]}), ("odds", None, ODDS | {"Prices": [1]}),
    ]
    data = [(i, k, v, "live", 1, None, json.dumps(p)) for i, (k, v, p) in enumerate(rows)]
    records = norm.normalize(spark.createDataFrame(data, "arrival long, " + RAW_INPUT_DDL))
    labels = {r.arrival: r.append_status for r in dedup.label_arrivals(records).collect()}
    assert labels == {0: "inserted", 1: "duplicate", 2: "conflict", 3: "conflict"}
    assert dedup.raw_conflicts(records).count() == 1


def test_audits_pass_on_good_events(spark):
    records = norm.normalize(raw(spark, ("odds", None, ODDS), ("score", None, UPPER), ("score", None, LOWER), ("fixture", None, FIXTURE)))
    events = norm.accepted_events(records)
    assert norm.envelope_violations(events).count() == 0 and norm.event_violations(events).count() == 0
    assert norm.raw_event_mismatches(norm.raw_records(records), events).count() == 0
    assert projections.latest_fixtures(events).count() == 1 and projections.quotes(events).count() == 3


def test_missing_evidence_is_reported(spark):
    decisions = spark.createDataFrame([("d", "e1", ["e2"])], "decision_id string, trigger_event_id string, evidence_event_ids array<string>")
    events = norm.accepted_events(norm.normalize(raw(spark, ("score", None, UPPER))))
    _, missing = receipts.receipt_evidence(decisions, events)
    assert {r.missing_event_id for r in missing.collect()} == {"e1", "e2"}
