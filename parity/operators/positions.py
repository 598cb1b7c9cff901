"""Exact positions in a declared order, without putting a group or the whole frame in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parity.operators.joins import null_safe
from parity.session import pinned

CHUNK = "__chunk"
INDEX = "__index"

#: monotonically_increasing_id keeps the row number in the low 33 bits.
_ROW_BITS = 1 << 33


def chunked(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], partitions: int | None = None
) -> DataFrame:
    """Range-partition and sort by keys and order, and name each row's partition and place in it.

    A large group spans several neighbouring partitions ("chunks"); chunk numbers grow with the
    order. Pinned, because the numbers depend on sampled bounds and are read more than once.
    """
    by = [*[F.col(k) for k in keys], *order]
    count = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(count, *by).sortWithinPartitions(*by)
    return pinned(
        ranged.withColumns(
            {
                CHUNK: F.spark_partition_id(),
                INDEX: F.pmod(F.monotonically_increasing_id(), F.lit(_ROW_BITS)),
            }
        )
    )


def carries(chunks: DataFrame, keys: Sequence[str], aggregates: dict[str, tuple[Column, str]]) -> DataFrame:
    """What the earlier chunks of a group add up to, one row per chunk that continues a group.

    Every partition can continue at most one group, so the result has fewer rows than partitions.
    ``aggregates`` maps a name to (aggregate expression, function that combines chunks).
    """
    summary = chunks.groupBy(*keys, CHUNK).agg(*[agg.alias(name) for name, (agg, _) in aggregates.items()])
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    combined = {
        name: getattr(F, combine)(name).over(before) for name, (_, combine) in aggregates.items()
    }
    first = F.min(CHUNK).over(Window.partitionBy(*keys))
    return (
        summary.withColumns({**combined, "__first": first})
        .filter(F.col(CHUNK) > F.col("__first"))
        .drop("__first")
    )


def with_carries(chunks: DataFrame, keys: Sequence[str], carried: DataFrame) -> DataFrame:
    """Attach the carries to every row of their chunk. Broadcast: fewer rows than partitions."""
    renamed = carried.withColumnsRenamed({c: f"__c_{c}" for c in (*keys, CHUNK)})
    pairs = [(chunks[k], renamed[f"__c_{k}"]) for k in (*keys, CHUNK)]
    return chunks.join(F.broadcast(renamed), null_safe(pairs), "left").drop(
        *[f"__c_{c}" for c in (*keys, CHUNK)]
    )


def with_positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str = "__pos",
    partitions: int | None = None,
) -> DataFrame:
    """Add each row's 0-based position within its key group (whole frame when there are no keys)."""
    chunks = chunked(df, keys, order, partitions)
    if not keys:
        sizes = chunks.groupBy(CHUNK).agg(F.count(F.lit(1)).alias("__n"))
        everything = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        # one row per partition: the only place where a window without keys is harmless
        offsets = sizes.select(
            F.col(CHUNK).alias("__c"), F.coalesce(F.sum("__n").over(everything), F.lit(0)).alias("__off")
        )
        placed = chunks.join(F.broadcast(offsets), chunks[CHUNK] == offsets["__c"])
        return placed.withColumn(name, F.col("__off") + F.col(INDEX)).drop("__c", "__off", CHUNK, INDEX)
    carried = carries(chunks, keys, {"__off": (F.count(F.lit(1)), "sum")})
    local = Window.partitionBy(*keys, CHUNK).orderBy(INDEX)
    placed = with_carries(chunks, keys, carried)
    position = (F.row_number().over(local) - 1 + F.coalesce("__off", F.lit(0))).cast("bigint")
    return placed.withColumn(name, position).drop("__off", CHUNK, INDEX)
