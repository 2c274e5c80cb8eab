"""Checked size bounds: what is broadcast or collected is counted first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a broadcast side may have.
BROADCAST_ROWS = 100_000


class LimitExceeded(ValueError):
    """A resource guard: there is no partial result."""


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most that many rows, else df: Spark then joins in another way."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def at_most(df: DataFrame, rows: int, what: str) -> DataFrame:
    """df, unless it has more rows than that."""
    if df.limit(rows + 1).count() > rows:
        raise LimitExceeded(f"more than {rows} {what}")
    return df
