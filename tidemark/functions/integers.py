"""Exact integer arithmetic on Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(numerator: Column, denominator) -> Column:
    """Integer division truncating toward zero."""
    other = denominator if isinstance(denominator, Column) else F.lit(denominator)
    return F.call_function("div", numerator, other)


def mean_rounded(total: Column, count: Column) -> Column:
    """Mean of non-negative integers rounded half up; null for no values."""
    safe = F.greatest(count, F.lit(1))
    return F.when(count > 0, div(total * 2 + safe, safe * 2))
