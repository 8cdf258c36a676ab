"""Steps whose rows, frames and files must not grow faster than the feed."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidemark.config import ConsensusConfig, EvaluationConfig
from tidemark.functions.staging import stage
from tidemark.operators import consensus, evaluation, risk
from tidemark.plans import feed_queries
from tidemark.sources import sample_feed as feed

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_a_stage_reads_only_the_columns_asked_for(spark):
    kept = stage(spark.range(50).selectExpr("id", "repeat('x', 100) AS wide", "struct(id AS a, NULL AS b) AS s").selectExpr("id", "wide", "s.a"))
    assert kept.count() == 50 and kept.agg(F.sum("a")).first()[0] == 1225
    plan = _plan(kept.select("id"))
    assert "ReadSchema: struct<id:bigint>" in plan


def test_the_fold_reads_narrow_rows(spark):
    t = feed_queries.FeedTables(spark, SF)
    cut = risk.segments(t.inputs, feed_queries.POLICIES)
    assert not {"features", "signal", "policy", "pause_reasons", "ord"} & set(cut.columns)
    assert cut.count() == 3 * t.inputs.count()


def test_decisions_of_rows_without_market_or_that_come_twice_stay_apart(spark):
    t = feed_queries.FeedTables(spark, SF)
    some = t.inputs.filter("market_id IN ('m1', 'm2')")
    odd = some.filter("market_id = 'm2'").withColumn("market_id", F.lit(None).cast("string"))
    both = stage(some.unionByName(odd).unionByName(some.filter("market_id = 'm1'")))
    decided = risk.decide(both, {"base": feed.POLICY})
    assert decided.count() == both.count()
    got = {r["market_id"]: (r["n"], r["v"]) for r in decided.groupBy("market_id").agg(F.count("*").alias("n"), F.count_distinct("expected_state_version").alias("v")).collect()}
    assert got["m1"][0] == got["m1"][1] == 2 * some.filter("market_id = 'm1'").count()
    assert got[None][0] == got["m2"][0]


def test_quotes_are_not_repeated_for_every_bookmaker(spark):
    t = feed_queries.FeedTables(spark, SF)
    found = consensus._current_quotes(t.quotes, feed.CONSENSUS)
    assert "collect_list" not in _plan(found)
    rows = [r.asDict() for r in t.quotes.select("market_id", "bookmaker_id", "event_id", "ord", "observed_at_ms").collect()]
    want = {}
    for r in rows:
        seen = {}
        for o in rows:
            if o["market_id"] == r["market_id"] and o["ord"] <= r["ord"]:
                mark = (o["observed_at_ms"], o["event_id"])
                seen[o["bookmaker_id"]] = max(seen.get(o["bookmaker_id"], mark), mark)
        want[r["event_id"]] = sorted(e for _, e in seen.values())
    got = {r["event_id"]: sorted(r["ids"]) for r in found.selectExpr("event_id", "latest.event_id AS ids").collect()}
    assert got == want


def test_convergence_windows_are_running_values(spark):
    rng = random.Random(7)
    window, tolerance, threshold = 50, 30_000, 20_000
    rows, times = [], {}
    for f in range(6):
        at, p = 1_000, 500_000
        for n in range(120):
            at += rng.choice([0, 1, 3, 7, 20])
            p = min(900_000, max(100_000, p + rng.choice([0, 1_000, -1_000, 40_000 if n % 37 == 0 else 5_000])))
            ready = rng.random() > 0.03
            names = ["a", "b"] if rng.random() > 0.02 else ["a", "c"]
            outcomes = [(names[0], p), (names[1], 1_000_000 - p)] if ready else []
            rows.append((f"f{f}", f"m{f}", f"e{f}-{n:03}", at, "ready" if ready else "insufficient", outcomes))
    trace = spark.createDataFrame(rows, "fixture_id string, market_id string, event_id string, snapshot_t bigint, status string, outcomes array<struct<outcome_id:string,probability_micros:bigint>>")
    sig = spark.createDataFrame([(f"f{f}", 1_000) for f in range(6)], "fixture_id string, signal_t bigint")
    first = "array(named_struct('outcome_id', 'a', 'probability_micros', 500000L), named_struct('outcome_id', 'b', 'probability_micros', 500000L))"
    base = sig.selectExpr("fixture_id", "concat('m', substring(fixture_id, 2)) AS market_id", "'ready' AS baseline_status", f"{first} AS baseline_outcomes")
    for coverage in ("spanning", "exact"):
        config = EvaluationConfig(convergence_tolerance_micros=tolerance, convergence_window_ms=window, material_move_threshold_micros=threshold, coverage=coverage)
        found = evaluation.convergence(trace, sig, base, config)
        assert "RangeFrame, 0" not in _plan(found) and f"{window})" not in _plan(found).split("RangeFrame")[-1][:40]
        want = {}
        for f in range(6):
            own = [r for r in rows if r[0] == f"f{f}"]
            for r in sorted(own, key=lambda r: (r[3], r[2])):
                inside = [o for o in own if r[3] <= o[3] <= r[3] + window]
                here = dict(r[5])
                moved = r[4] == "ready" and set(here) == {"a", "b"} and max(abs(v - 500_000) for v in here.values()) >= threshold
                ends = max(o[3] for o in inside)
                covered = ends == r[3] + window if coverage == "exact" else max(o[3] for o in own) >= r[3] + window
                agree = all(set(dict(o[5])) == set(here) and all(abs(dict(o[5])[k] - v) <= tolerance for k, v in here.items()) for o in inside)
                if moved and covered and agree:
                    want[r[0]] = (r[3], r[2])
                    break
        assert {r["fixture_id"]: (r["convergence_t"], r["convergence_event_id"]) for r in found.collect()} == want
        assert want
