"""Running (prefix) computations that keep a hot key parallel.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task.  Here a
key is cut into time chunks: one window runs inside each (key, chunk), one small
window runs over the per-chunk summaries, and the carry joins back.  The summary
holds at most one row per key and calendar chunk, so it does not grow with the
number of events.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.integers import div


@dataclass(frozen=True)
class Running:
    """One running value. ``kind``: ``last`` or ``first`` (both ignoring nulls), ``max`` or ``sum``."""

    name: str
    kind: str
    value: Column
    inclusive: bool = True


def chunk_of(time_ms: Column, chunk_ms: int) -> Column:
    return div(time_ms, chunk_ms)


def _frame_value(kind: str, col: Column, frame) -> Column:
    if kind == "last":
        return F.last(col, ignorenulls=True).over(frame)
    if kind == "first":
        return F.first(col, ignorenulls=True).over(frame)
    return (F.max if kind == "max" else F.sum)(col).over(frame)


def running(
    df: DataFrame, keys: Sequence[str], order: str, chunk: str, specs: Sequence[Running]
) -> DataFrame:
    """Append one column per spec, computed over ``keys`` in ``order``.

    ``chunk`` must be non-decreasing in ``order`` within a key; ``order`` must be unique
    within a key and is never null.
    """
    values = {s.name: f"__v_{s.name}" for s in specs}
    staged = df.select("*", *[s.value.alias(values[s.name]) for s in specs])
    group = [*keys, chunk]
    summary_aggs, carry_cols = [], []
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    for s in specs:
        col = F.col(values[s.name])
        known = F.when(col.isNotNull(), F.col(order))
        summary = {
            "last": lambda: F.max_by(col, known),
            "first": lambda: F.min_by(col, known),
            "max": lambda: F.max(col),
            "sum": lambda: F.sum(col),
        }[s.kind]()
        summary_aggs.append(summary.alias(f"__s_{s.name}"))
        carry_cols.append(_frame_value(s.kind, F.col(f"__s_{s.name}"), before).alias(f"__c_{s.name}"))
    summary = staged.groupBy(*group).agg(*summary_aggs)
    carry = summary.select(*group, *carry_cols)
    joined = staged.join(carry, group, "left")
    out = [F.col(c) for c in df.columns]
    for s in specs:
        frame = Window.partitionBy(*group).orderBy(order)
        frame = frame.rowsBetween(Window.unboundedPreceding, 0 if s.inclusive else -1)
        col, carried = F.col(values[s.name]), F.col(f"__c_{s.name}")
        local = _frame_value(s.kind, col, frame)
        combined = {
            "last": lambda: F.coalesce(local, carried),
            "first": lambda: F.coalesce(carried, local),
            "max": lambda: F.greatest(local, carried),
            "sum": lambda: F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0)),
        }[s.kind]()
        out.append(combined.alias(s.name))
    return joined.select(*out)
