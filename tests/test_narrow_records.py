"""Queries that read identities alone neither compute nor store the events of their records."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tidemark.operators import normalize as norm
from tidemark.plans import feed_queries
from tidemark.schemas import RAW_INPUT_DDL

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _rows(df) -> list[str]:
    return sorted(r["j"] for r in df.select(F.to_json(F.struct("*")).alias("j")).collect())


def test_an_object_is_gone_through_once(spark):
    payload = {"Data": {"Goal": True, "Id": 7}, "data": 1, "parti1StateSoccer": {"PossibleEvent": {"Goal": None}}, "Ts": "5", "ts": 6.0}
    source = spark.createDataFrame([(json.dumps(payload),), ("[1]",), ("no json",), (None,)], "payload string")
    bound = norm._with_fields(source.withColumn("v", F.try_parse_json("payload")))
    assert _plan(bound.drop("v", *norm._BOUND)).count("variant_get(") < len(norm._FIELDS)
    seen = ["Data.Goal", "Data.Id", "Data.VAR", "parti1StateSoccer.PossibleEvent.Goal", "Ts", "ts"]
    got = bound.select(*[norm._json(p) for p in seen], norm._integer("ts")).collect()
    assert tuple(got[0]) == ("true", "7", None, "null", '"5"', "6", 6)
    assert all(x is None for row in got[1:] for x in row)


def test_identities_need_no_events(spark):
    kept = feed_queries.FeedTables(spark, SF)
    narrow, wide = feed_queries.raw_identity(feed_queries.FeedTables(spark, SF)), kept.normalized
    assert not any(word in _plan(narrow) for word in ("mkt_", "out_", "participants"))
    assert _rows(narrow) == _rows(feed_queries.raw_identity(kept))
    assert wide.filter("odds IS NOT NULL").count() > 0


def test_the_raw_event_audit_stores_no_payloads(spark):
    t = feed_queries.FeedTables(spark, SF)
    found = feed_queries.raw_event_audit(t)
    assert not set(norm.PAYLOADS) & set(t.labelled_identities.columns)
    kept = feed_queries.FeedTables(spark, SF)
    assert kept.labelled.count() > 0 and "payload" in kept.labelled_identities.columns
    assert _rows(found) == _rows(feed_queries.raw_event_audit(kept)) != []


def test_issues_of_bad_records_stay_as_they_were(spark):
    odds = {
        "Bookmaker": "B", "BookmakerId": 1, "FixtureId": 2, "InRunning": True, "MessageId": "m", "PriceNames": ["a", "b"], "Prices": [1, 2],
        "Pct": ["NA", "50.000"], "SuperOddsType": "1X2", "Ts": 3,
    }
    cases = [
        ({}, None),
        ({"Pct": [50.0, "50.000"]}, ["Pct: expected NA or three decimals"]),
        ({"Pct": 5}, ["Pct: expected NA or three decimals", "Pct: Pct and PriceNames differ in length", "Pct: above 100.000"]),
        ({"Pct": ["100.001", "NA"]}, ["Pct: above 100.000"]),
        ({"PriceNames": ["1", 1]}, ["PriceNames: expected non-empty texts", "PriceNames: names repeat"]),
        ({"Ts": 7.0}, None),
        ({"Ts": "7"}, ["Ts: expected integer"]),
    ]
    raw = spark.createDataFrame([("odds", None, "live", i, None, json.dumps(odds | x)) for i, (x, _) in enumerate(cases)], RAW_INPUT_DDL)
    got = {r["received_at_ms"]: r["quarantine_issues"] for r in norm.normalize(raw).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]
