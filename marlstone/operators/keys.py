"""Joins on keys of which a null is one of the values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_on(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right`` where ``by`` is the same, nulls too; left names stay unique."""
    marked = {c: f"_on_{c}" for c in by}
    right = right.withColumnsRenamed(marked)
    return left.join(right, [left[c].eqNullSafe(right[m]) for c, m in marked.items()], how).drop(*marked.values())
