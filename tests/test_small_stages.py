"""Stages hold what later steps read, and leave no shuffle files behind."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tidemark.functions.staging import _CLEANUP, stage
from tidemark.operators import consensus, evaluation
from tidemark.plans import feed_queries
from tidemark.sources import sample_feed as feed

SF = "/root/testdata/sf0.001"


def _rows(df) -> list[str]:
    return sorted(r["j"] for r in df.select(F.to_json(F.struct("*")).alias("j")).collect())


def _shuffle_files(spark) -> int:
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    folders = [str(x) for x in manager.localDirs()]
    return sum(name.startswith("shuffle_") for top in folders for _, _, names in os.walk(top) for name in names)


def test_a_stage_leaves_no_shuffle_files(spark):
    before, given = _shuffle_files(spark), spark.conf.get(_CLEANUP, None)
    kept = stage(spark.range(1_000).groupBy((F.col("id") % 7).alias("k")).count())
    assert _shuffle_files(spark) <= before and spark.conf.get(_CLEANUP, None) == given
    assert kept.agg(F.sum("count")).first()[0] == 1_000


def test_receipts_of_an_audit_are_stored_without_documents(spark):
    narrow, wide = feed_queries.FeedTables(spark, SF), feed_queries.FeedTables(spark, SF)
    found = _rows(feed_queries.verification_audit(narrow))
    assert not {"decision_json", "evidence", "payload_hash"} & set(narrow.receipt_heads.columns) and "receipts" not in narrow.__dict__
    assert wide.receipts.count() > 0 and wide.receipt_heads is wide.receipts
    assert found == _rows(feed_queries.verification_audit(wide)) != []


def test_ids_of_the_trace_are_computed_where_they_are_read(spark):
    t = feed_queries.FeedTables(spark, SF)
    assert _rows(t.trace) == _rows(consensus.consensus_trace(t.events, feed.CONSENSUS).select(*t.trace.columns))
    assert "cns_" not in t.trace.select("market_id", "status")._jdf.queryExecution().optimizedPlan().toString()
    plain = feed_queries.FeedTables(spark, SF).observations
    assert not {"consensus_id", *consensus.PROVENANCE} & set(plain.columns)
    assert _rows(plain) == _rows(t.trace.select(*plain.columns))


def test_evaluations_read_narrow_decisions(spark):
    t, wide = feed_queries.FeedTables(spark, SF), feed_queries.FeedTables(spark, SF)
    found = _rows(feed_queries.evaluation_timeline(t))
    assert tuple(t.sweep_states.columns) == evaluation.DECISION_COLUMNS and "sweep_decisions" not in t.__dict__
    assert wide.sweep_decisions.count() > 0 and wide.sweep_states is wide.sweep_decisions
    assert found == _rows(feed_queries.evaluation_timeline(wide)) != []


def test_the_overview_stores_no_fixture_records(spark):
    t = feed_queries.FeedTables(spark, SF)
    found = feed_queries.overview(t).first()
    assert "fixture_events" not in t.__dict__ and "receipts" not in t.__dict__
    assert t.latest_fixtures.count() == found["fixtures"] and t.receipt_heads.count() == found["pending_proofs"]
