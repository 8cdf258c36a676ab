"""Rows of a scan are dealt evenly, however row groups and splits lie."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.functions.staging import spread
from tidemark.operators import normalize as norm
from tidemark.sources import sample_feed as feed

ROWS = 20_000


@pytest.fixture
def many_splits(spark):
    """Files are cut into more splits than there are cores; a row group still lies in one of them."""
    settings = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "1"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name in settings:
        spark.conf.unset(name)


def _largest(df):
    return max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


def test_one_row_group_is_dealt_to_all_cores(spark, many_splits, tmp_path):
    pq.write_table(pa.table({"n": range(ROWS)}), str(tmp_path / "t.parquet"))
    scan = spark.read.parquet(str(tmp_path / "t.parquet"))
    assert scan.rdd.getNumPartitions() >= 8 and _largest(scan) == ROWS
    dealt = spread(scan, "n")
    assert _largest(dealt) < ROWS // 4
    assert dealt.agg(F.sum("n")).first()[0] == ROWS * (ROWS - 1) // 2


def test_tasks_grow_with_the_rows(spark):
    assert spread(spark.range(ROWS).toDF("n"), "n", rows_a_task=500).rdd.getNumPartitions() == 40


def test_fixture_records_are_dealt_to_all_cores(spark, many_splits, tmp_path):
    rows = spark.range(ROWS).selectExpr("id AS o_orderkey", "id % 50 AS o_custkey", "timestamp'1995-01-01 00:00:00' AS o_orderdate")
    pq.write_table(pa.Table.from_pandas(rows.toPandas()), str(tmp_path / "orders.parquet"), coerce_timestamps="us")
    assert _largest(feed.raw_fixtures(spark, str(tmp_path))) < ROWS // 4


def test_parsed_fields_are_left_behind_once_used(spark):
    parsed = norm.odds_issues(spark.createDataFrame([("{}",)], "payload string"))
    assert parsed.columns == ["payload", "issues"]
    bound = norm._with_fields(spark.createDataFrame([("{}",)], "payload string").withColumn("v", F.try_parse_json("payload")))
    kept = norm._narrow(bound, norm._integer("Ts"), norm._string("MessageId"))
    assert kept.columns == ["payload", "v", norm._json("MessageId"), norm._integer("Ts")]
