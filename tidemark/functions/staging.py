"""Stage boundaries: a table that several later steps read is computed once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of reliable checkpoints.

    The cluster's own ``spark.checkpoint.dir`` always wins.  Only a local session that names
    none gets a scratch folder; on a cluster that names none this is an error, because plans
    without their stage boundaries would be computed over and over.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        configured = context.getConf().get("spark.checkpoint.dir", None)
        if not configured and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    return context.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there.

    The files survive the loss of executors and cut the lineage.  They are columnar and
    compressed, and a later step reads only the columns it needs.
    """
    if df.isStreaming:
        return df
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/stage-{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile go at its end, not when the driver collects its garbage.

    A driver that does little seldom does that, and the files of all stages before would lie on the disks.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def fence(df: DataFrame) -> DataFrame:
    """Keep later predicates from being rewritten in terms of what computes ``df``.

    A filter on a derived column is otherwise pushed below its projection and re-evaluates
    the whole expression behind the column; through a generator it is not.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))


ROWS_A_TASK = 50_000


def spread(scan: DataFrame, key: str, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """Deal the rows of a scan evenly to tasks of about ``rows_a_task``, for costly work that follows.

    The number of splits does not tell how rows lie in them: a Parquet row group is read whole by
    one task, and the splits that only cut through it are empty.  So the rows are counted, which
    reads no more than the footers, and there are at least as many tasks as cores.
    """
    if scan.isStreaming:
        return scan
    tasks = -(-scan.count() // rows_a_task)
    return scan.repartition(max(scan.sparkSession.sparkContext.defaultParallelism, tasks), key)
