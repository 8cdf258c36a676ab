"""Shared helpers: tables, written stage boundaries, byte-level word splitting, logistic fits."""

from __future__ import annotations

import sys
import tempfile
import uuid

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A-Z to a-z, every other ASCII character but letters to a blank; bytes of other scripts stay.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
# The same, digits kept.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c > 127 else 32 for c in range(256))


# Texts are long and of very different lengths: Python workers get few rows at a time.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1_000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches of the session to BATCH, unless the session sets them itself."""
    given = spark.conf.getAll
    for key, most in BATCH.items():
        if key not in given:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; a scratch folder on a local master."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if context.master.startswith("local["):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="llm-"))
        return context.getCheckpointDir()
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, independent of executors."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "replace") if text else b""


def labelled(documents: DataFrame, labels: DataFrame, target: Column, keep: Column, limit: int) -> DataFrame:
    """At most ``limit`` labelled documents, chosen by a hash of doc_id: the documents and ``target``.

    One row per label id; rows without id or label do not count.  The chosen ids are at most
    ``limit`` rows, so they are broadcast.
    """
    chosen = (
        labels.select("doc_id", target.cast("int").alias("target"))
        .where(F.col("doc_id").isNotNull() & F.col("target").isNotNull() & keep)
        .groupBy("doc_id")
        .agg(F.max("target").alias("target"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    return documents.join(F.broadcast(chosen), "doc_id")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-3) -> np.ndarray:
    """Newton's method for ridge logistic regression; returns the weights, intercept last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.ones(len(x)) if weight is None else weight
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], l2 * max(weight.sum(), 1.0))
    ridge[-1] = 1e-6
    for _ in range(30):
        p = sigmoid(x @ w)
        gradient = x.T @ (weight * (p - y)) + ridge * w
        hessian = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
