"""Broadcasts of tables whose size is checked first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL_BYTES = 16 << 20


def broadcast_if_small(rows: DataFrame, most: int = SMALL_BYTES) -> DataFrame:
    """``rows`` marked for a broadcast if their values take at most ``most`` bytes; as they are otherwise, for a shuffled join."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in rows.columns), F.lit(16))
    return F.broadcast(rows) if rows.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"] <= most else rows
