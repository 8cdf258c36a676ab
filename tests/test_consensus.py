"""Consensus known answers, exactness and invariance."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.config import ConsensusConfig
from tidemark.operators import consensus as con
from tidemark.sources import sample_feed as feed

SF = "/root/testdata/sf0.001"
QUOTES = (
    "market_id string, bookmaker_id string, bookmaker_name string, event_id string, observed_at_ms long, "
    "outcomes array<struct<outcome_id: string, name: string, reported_micros: long>>"
)
CONFIG = ConsensusConfig(min_fresh_bookmakers=2, stale_after_ms=5_000)


def quote(book, at, micros, ids=("home", "draw", "away"), market="m"):
    return (market, book, book.upper(), f"{book}-{at}", at, [(i, i, m) for i, m in zip(ids, micros)])


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), QUOTES)


def test_normalization_and_codes(spark):
    rows = frame(
        spark,
        quote("a", 1, (500_000, 300_000, 300_000)),
        quote("b", 1, (500_000, None, 500_000)),
        quote("c", 1, (1,), ("home",)),
        quote("d", 1, (1, 2), ("home", "home")),
        quote("e", 1, (0, 0), ("home", "away")),
    )
    found = {r.bookmaker_id: r for r in con.normalize_vectors(rows).collect()}
    assert {o.outcome_id: o.probability_micros for o in found["a"].vector} == {"home": 454_546, "draw": 272_727, "away": 272_727}
    assert found["a"].overround_micros == 100_000
    assert [found[b].code for b in "bcde"] == [
        "missing_reported_probability", "empty_outcome_vector", "duplicate_outcome", "nonpositive_probability_sum",
    ]


def test_median_stale_and_ages(spark):
    rows = frame(
        spark,
        quote("a", 10_000, (500_000, 300_000, 200_000)),
        quote("same", 10_100, (500_000, 300_000, 200_000)),
        quote("outlier", 10_200, (900_000, 50_000, 50_000)),
        quote("stale", 1_000, (100_000, 100_000, 800_000)),
    )
    row = con.consensus_at(rows, 11_000, CONFIG).head()
    assert {o.outcome_id: o.probability_micros for o in row.outcomes} == {"home": 500_000, "draw": 300_000, "away": 200_000}
    assert (row.fresh_bookmaker_count, row.stale_bookmaker_count, row.stale_ppm) == (3, 1, 250_000)
    assert (row.freshest_age_ms, row.oldest_fresh_age_ms) == (800, 1_000)


def test_outcome_set_mismatch_and_future(spark):
    rows = frame(
        spark,
        quote("a", 10, (500_000, 300_000, 200_000)),
        quote("b", 10, (500_000, 300_000, 200_000)),
        quote("c", 10, (500_000, 500_000), ("home", "away")),
        quote("d", 99, (500_000, 300_000, 200_000)),
    )
    row = con.consensus_at(rows, 50, CONFIG).head()
    assert row.status == "ready" and row.valid_bookmaker_count == 2 and row.fresh_bookmaker_count == 3
    assert [(d.code, d.bookmaker_id) for d in row.diagnostics] == [("future_quote", "d"), ("outcome_set_mismatch", "c")]


def test_all_zero_medians_do_not_fail_the_job(spark):
    ids = ("home", "draw", "away")
    rows = frame(spark, *[quote(b, 10, [1_000_000 if i == k else 0 for i in range(3)], ids) for k, b in enumerate("abc")])
    row = con.consensus_at(rows, 10, CONFIG).head()
    assert row.status == "insufficient" and row.outcomes == []
    assert [d.code for d in row.diagnostics] == ["degenerate_median"]


def test_reaction_latency(spark):
    base = [("home", "home", 500_000), ("draw", "draw", 300_000), ("away", "away", 200_000)]
    signals = spark.createDataFrame(
        [("s", "m", 20_000, "ready", sorted(base))],
        "signal_id string, market_id string, signal_t long, baseline_status string, "
        "baseline_outcomes array<struct<outcome_id: string, name: string, probability_micros: long>>",
    )
    rows = frame(
        spark,
        quote("a", 21_000, (500_000, 300_000, 200_000)),
        quote("a", 22_500, (550_000, 270_000, 180_000)),
        quote("b", 23_000, (510_000, 295_000, 195_000)),
    )
    found = {r.bookmaker_id: r.latency_ms for r in con.reaction_latency(signals, rows, 30_000).collect()}
    assert found == {"a": 2_500, "b": None}


def test_superseded_quote_repeats_the_snapshot(spark):
    events = feed.events(spark, SF).filter("kind = 'odds.observed' AND odds.market.market_id = 'm3'").orderBy("source_timestamp_ms").limit(6)
    first = events.limit(1)
    # the same bookmaker and time again, later in the order but with a smaller event id
    late = first.withColumns({"event_id": F.lit("evt_0"), "sequence": F.lit(5).cast("long")})
    rows = con.consensus_trace(events.unionByName(late), feed.CONSENSUS).orderBy("ord").collect()
    assert [r.superseded for r in rows] == [False, True] + [False] * 5
    assert rows[1].consensus_id == rows[0].consensus_id


def test_order_partitioning_and_chunks_do_not_matter(spark):
    events = feed.events(spark, SF).filter("fixture_id = '3'")
    shuffled = events.repartition(7, F.rand(3)).orderBy(F.rand(5))
    wide = ConsensusConfig(2, feed.CONSENSUS.stale_after_ms, chunk_ms=10_000_000_000)
    ids = [
        {tuple(r) for r in con.consensus_trace(e, c).select("event_id", "consensus_id").collect()}
        for e, c in ((events, feed.CONSENSUS), (shuffled, feed.CONSENSUS), (events, wide))
    ]
    assert len(ids[0]) > 20 and ids[0] == ids[1] == ids[2]


def test_probabilities_add_up(spark):
    trace = con.consensus_trace(feed.events(spark, SF), feed.CONSENSUS).filter("status = 'ready'")
    total = F.aggregate("outcomes", F.lit(0).cast("long"), lambda a, o: a + o["probability_micros"])
    assert trace.filter(total != 1_000_000).count() == 0
