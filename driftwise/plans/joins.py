"""Join helpers with explicit size checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` only when a count proves it has at most ``max_rows`` rows; else leave the join to a shuffle."""
    n = df.count()
    return F.broadcast(df) if n <= max_rows else df
