"""Features as of the event's own time, against a plain replay of the quotes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.config import ConsensusConfig
from tidemark.operators import consensus as con
from tidemark.operators import risk
from tidemark.sources import sample_feed as feed
from tests.seeded import T0, seeded_events

SF = "/root/testdata/sf0.001"


def _features(events, config, fanout="last_market", feature_time="event"):
    trace = con.consensus_trace(events, config)
    rows = risk.attribute(events, trace, config, fanout, feature_time).collect()
    assert len({(r["market_id"], r["event_id"]) for r in rows}) == len(rows)
    return {(r["market_id"], r["event_id"]): r["features"] for r in rows}


def test_seeded_score_sees_the_age_of_its_own_time(spark):
    events, config = seeded_events(spark), ConsensusConfig(stale_after_ms=30_000)
    score = events.filter("kind = 'score.observed'").first()["event_id"]
    kept = {e: f for (_, e), f in _features(events, config, feature_time="snapshot").items()}
    aged = {e: f for (_, e), f in _features(events, config).items()}
    # the only quote before it is 59 s old by then: stale, where the last snapshot called it fresh
    assert (kept[score]["consensus_status"], kept[score]["oldest_fresh_age_ms"], kept[score]["stale_ppm"]) == ("ready", 0, 0)
    assert (aged[score]["consensus_status"], aged[score]["oldest_fresh_age_ms"], aged[score]["stale_ppm"]) == ("insufficient", None, 1_000_000)
    patient = {e: f for (_, e), f in _features(events, ConsensusConfig(stale_after_ms=59_000)).items()}
    assert patient[score]["oldest_fresh_age_ms"] == 59_000 and patient[score]["max_abs_velocity"] == 0
    assert {e: f for e, f in aged.items() if e != score} == {e: f for e, f in kept.items() if e != score} and T0


@pytest.mark.parametrize("fanout", ["last_market", "all_markets"])
def test_ages_against_a_replay(spark, fanout):
    """Equal times and several markets: each event sees what came before it in event order, aged to its time."""
    config = ConsensusConfig(min_fresh_bookmakers=2, stale_after_ms=200_000_000, chunk_ms=100_000_000)
    coarse = (F.floor(F.col("source_timestamp_ms") / 21_600_000) * 21_600_000).cast("long")
    events = feed.events(spark, SF).filter("fixture_id IN ('1', '4')").withColumn("source_timestamp_ms", coarse)
    got = _features(events, config, fanout)
    order = F.struct("source_timestamp_ms", "sequence", "source_priority", "source_id", "idempotency_key", "event_id")
    rows = events.orderBy(order).select(
        "event_id", "fixture_id", "kind", F.col("source_timestamp_ms").alias("t"), "odds.market.market_id", F.col("odds.bookmaker.id").alias("book")
    ).collect()
    held, last, seen, differing = {}, {}, {}, 0
    valid = {r["event_id"] for r in con.normalize_vectors(con.quote_vectors(events)).filter("code IS NULL").collect()}
    kept = _features(events, config, fanout, "snapshot")
    for r in rows:
        if r["market_id"] is not None:
            quotes = held.setdefault(r["market_id"], {})
            if (r["t"], r["event_id"]) > quotes.get(r["book"], (-1, ""))[:2]:
                quotes[r["book"]] = (r["t"], r["event_id"])
            last[r["fixture_id"]] = r["market_id"]
            seen.setdefault(r["fixture_id"], {})[r["market_id"]] = None
            continue
        markets = list(seen.get(r["fixture_id"], {})) if fanout == "all_markets" else [last.get(r["fixture_id"])]
        for market in filter(None, markets):
            f = got[market, r["event_id"]]
            ages = [r["t"] - t for t, _ in held[market].values()]
            fresh = [r["t"] - t for t, e in held[market].values() if r["t"] - t <= config.stale_after_ms and e in valid]
            assert f["oldest_fresh_age_ms"] == (max(fresh) if fresh else None) and f["fresh_bookmaker_count"] == len(fresh)
            stale = sum(a > config.stale_after_ms for a in ages)
            assert f["stale_ppm"] == (2 * stale * 1_000_000 + len(ages)) // (2 * len(ages))
            differing += f != kept[market, r["event_id"]]
    assert differing > 20 and got.keys() == kept.keys()


def test_unknown_feature_time_is_refused(spark):
    events = seeded_events(spark)
    with pytest.raises(ValueError, match="feature time"):
        risk.attribute(events, con.consensus_trace(events, feed.CONSENSUS), feed.CONSENSUS, feature_time="later")
