"""Appends look only where their keys can be; a purge rewrites only folders with expired rows."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import normalize as norm
from tidemark.sources import raw as raw_source
from tidemark.sources import tables
from tests.test_appends import normalized, odds

DAY = tables.DAY_MS


def _files_read(frame):
    frame.collect()
    leaf = frame._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return leaf.metrics().get("numFiles").get().value()


def _files(path):
    return {os.path.join(folder, f): os.stat(os.path.join(folder, f)).st_mtime_ns for folder, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def _day(spark, day, count=4):
    return normalized(spark, [odds(f"d{day}-{k}", ts=day * DAY + k) for k in range(count)])


def test_a_batch_reads_the_same_whatever_the_history(spark, tmp_path):
    raw, events = str(tmp_path / "raw"), str(tmp_path / "events")
    layout = tables.Layout(key_buckets=4, horizon_days=1)
    read = []
    for day in range(10, 14):
        batch = _day(spark, day)
        placed = tables._placed(batch, "raw_key", layout)
        beside = tables.stored_beside(placed, raw, layout)
        read.append(0 if beside is None else _files_read(beside.select("idempotency_key", "raw_payload_hash")))
        if beside is not None:
            plan = beside._jdf.queryExecution().executedPlan().toString()
            assert "PartitionFilters: [" in plan and "key_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
        tables.write_batch(batch, raw, events, day, layout=layout)
    assert read[0] == 0 and 0 < max(read[1:]) <= 4 and len(_files(raw)) > 4
    # an exact repetition of an old record is found by its own day, a conflict within the horizon by the key
    tables.write_batch(_day(spark, 10), raw, events, 99, layout=layout)
    tables.write_batch(normalized(spark, [odds("d12-1", prices=(7, 8), ts=13 * DAY)]), raw, events, 100, layout=layout)
    assert spark.read.parquet(raw).count() == spark.read.parquet(events).count() == 16
    assert spark.read.parquet(raw + "_conflicts").count() == 1


def test_without_horizon_a_key_is_found_on_any_day(spark, tmp_path):
    raw, events = str(tmp_path / "raw"), str(tmp_path / "events")
    tables.write_batch(_day(spark, 10), raw, events, 0)
    batch = normalized(spark, [odds("d10-1", prices=(7, 8), ts=900 * DAY), odds("new", ts=5), "no json"]).persist()
    for attempt in range(2):  # the second time as after a failure
        tables.write_batch(batch, raw, events, 1 + attempt)
    assert spark.read.parquet(events).count() == 5 and spark.read.parquet(raw).count() == 6
    assert spark.read.parquet(raw + "_conflicts").count() == 1


def _stored_with_expiry(spark, path):
    rows = norm.raw_records(normalized(spark, [odds(f"m{k}", ts=(10 + k % 6) * DAY + k) for k in range(48)]))
    old = F.col("source_timestamp_ms") < 12 * DAY
    rows = rows.withColumns({
        "source": F.lit("historical"), "retention_expires_at_ms": F.when(old, F.lit(1_000)).otherwise(F.lit(10**15)).cast("long"),
    })
    tables._append(tables._placed(rows, "idempotency_key", tables.Layout(4)), path)
    return {r["ingest_id"] for r in rows.collect()}


def _state(spark, path):
    return {r["ingest_id"]: (r["raw_payload"] is None, r["payload_retained"], r["source_day"]) for r in spark.read.parquet(path).collect()}


def test_purge_rewrites_only_folders_with_expired_rows(spark, tmp_path):
    path = str(tmp_path / "raw")
    ids = _stored_with_expiry(spark, path)
    before = _files(path)
    count = tables.purge_table(spark, path, 2_000)
    after = _files(path)
    assert 0 < count <= 8
    kept = {f for f in before if "source_day=10" not in f and "source_day=11" not in f}
    assert kept and all(after[f] == before[f] for f in kept)
    assert not (set(before) - kept) & set(after)
    state = _state(spark, path)
    assert state.keys() == ids and all(gone == (day < 12) == (not retained) for gone, retained, day in state.values())
    assert tables.purge_table(spark, path, 2_000) == 0 and _files(path) == after
    assert tables.purge_table(spark, str(tmp_path / "absent"), 0) == 0


@pytest.mark.parametrize("moment", ["while writing the copy", "before the swap", "in the middle of the swap"])
def test_a_purge_that_is_cut_off_loses_nothing(spark, tmp_path, moment):
    path = str(tmp_path / "raw")
    ids = _stored_with_expiry(spark, path)
    stored = spark.read.parquet(path)
    rows = tables.purge_expired(stored.filter("source_day < 12"), 2_000).drop("purged")
    copy = path + "_purge"
    if moment == "while writing the copy":
        os.makedirs(copy + "/_temporary/0")
    else:
        rows.write.parquet(copy)
    if moment == "in the middle of the swap":
        for f in _files(path):
            if "source_day=10" in f:
                os.remove(f)
    tables.purge_table(spark, path, 2_000)
    state = _state(spark, path)
    assert state.keys() == ids and all(gone == (day < 12) for gone, _, day in state.values())
    assert len(spark.read.parquet(path).collect()) == len(ids)


def test_backfill_opens_only_planned_buckets(spark, tmp_path):
    path = str(tmp_path / "odds")
    hours = [(f"{k % 3}", k, odds(f"m{k}", ts=10 * DAY + k * 3_600_000, fixture=k % 3), 10 * DAY + k * 3_600_000) for k in range(72)]
    records = spark.createDataFrame(hours, "fixture_id string, arrival bigint, payload string, t bigint")
    raw_source.write_backfill(records, path, F.col("t"))
    chosen = spark.createDataFrame(
        [("1", 10 * DAY + 3_600_000, 10 * DAY + 8 * 3_600_000), ("2", 12 * DAY, 12 * DAY + 5 * 3_600_000), ("0", 5, 4)],
        "fixture_id string, source_start_ms bigint, source_end_ms bigint",
    )
    found = raw_source.read_backfill(spark, path, chosen)
    # the planned buckets, of whatever fixture: hours 1 to 8 of the first day, 0 to 5 of the third
    assert sorted(r["arrival"] for r in found.collect()) == [*range(1, 9), *range(48, 54)]
    assert "dynamicpruning" in found._jdf.queryExecution().optimizedPlan().toString()
    scans = found._jdf.queryExecution().executedPlan()
    leaves = scans.finalPhysicalPlan().collectLeaves() if "finalPhysicalPlan" in dir(scans) else scans.collectLeaves()
    files = [leaves.apply(k).metrics().get("numFiles") for k in range(leaves.size())]
    assert sum(f.get().value() for f in files if f.isDefined()) == 14 and len(_files(path)) == 72
    events, _, summary = raw_source.hydrate(records.limit(0).drop("t"), found, chosen)
    assert sorted(r["source_timestamp_ms"] for r in events.collect()) == [10 * DAY + k * 3_600_000 for k in (1, 4, 7, 50, 53)]
    assert {r["selected_fixture"]: r["refused"] for r in summary.collect()} == {"1": False, "2": False, "0": True}
    endless = chosen.withColumns({"source_start_ms": F.lit(0).cast("long"), "source_end_ms": F.lit(10**15).cast("long")})
    assert raw_source.read_backfill(spark, path, endless).count() == 72
    assert raw_source.read_backfill(spark, path, chosen.limit(0)).count() == 0
    assert raw_source.read_backfill(spark, path, chosen, most_buckets=1).count() == 14
    sparse = str(tmp_path / "sparse")
    raw_source.write_backfill(records, sparse, F.col("t"), folders=("epoch_day",))
    assert len(_files(sparse)) == 3 and raw_source.read_backfill(spark, sparse, chosen).count() == 14
