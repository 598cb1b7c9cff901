"""Measuring how large the largest group is, before a plan is chosen that would hold it in one task.

Aggregations combine before their shuffle and inner joins are split at run time by adaptive
execution. Ordered windows and outer joins are not: they keep one key in one task. Those operators
ask here first and take another, split plan when a group is too large.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group of up to this many rows is sorted by one task without trouble.
MAX_GROUP_ROWS = 10_000_000

#: A side is broadcast only below this size.
BROADCAST_LIMIT_BYTES = 10 * 1024 * 1024

#: More rows than this are not broadcast, whatever their width.
BROADCAST_LIMIT_ROWS = 1_000_000


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the largest key group, by an aggregation whose result is one row."""
    counts = df.groupBy(*keys).count() if keys else df.agg(F.count(F.lit(1)).alias("count"))
    return counts.agg(F.max("count").alias("n")).first()["n"] or 0


def has_hot_group(df: DataFrame, keys: Sequence[str], max_group_rows: int | None) -> bool:
    """True when some group exceeds the limit. None as the limit means the caller knows it does not."""
    if max_group_rows is None:
        return False
    return largest_group(df, keys) > max_group_rows


def broadcastable(df: DataFrame) -> bool:
    """True when the frame is measured to be below the broadcast limits in rows and in bytes.

    Estimates play no part: compressed columns and exploded rows both make them far too small. At most
    one row more than the limit is read.
    """
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    few = df.limit(BROADCAST_LIMIT_ROWS + 1).select(F.octet_length(text).alias("b"))
    row = few.agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b")).first()
    return row["n"] <= BROADCAST_LIMIT_ROWS and (row["b"] or 0) < BROADCAST_LIMIT_BYTES
