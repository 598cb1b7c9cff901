"""Alignment of two frames of equal size by sorted position, when there is no key to join on.

Sorting rows as they are would put all copies of one row in one task. Equal rows of both sides are
therefore counted together first, and the distinct rows are cut by common splitters and sorted. A
distinct row then covers a range of positions on each side; where the two ranges overlap both sides hold
the same row and there is nothing to compare. Only the rest is laid over each other, in blocks of
positions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parity.functions.types import quoted
from parity.operators.frame import order_columns
from parity.operators.positions import CHUNK, INDEX, chunked

#: Positions per block: one task's share of the overlay.
BLOCK = 1_000_000

#: Rows per range of the sort.
CHUNK_ROWS = 2_000_000


def _ranges(counted: DataFrame, columns: Sequence[str], sides: Sequence[str], rows: int) -> DataFrame:
    """Distinct rows as ``row``; of each side the range ``[from_, to_)`` they cover in its sorted order.

    ``counted`` has a count ``__n_`` for each side; ``rows`` bounds its rows from above.
    """
    spark = counted.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // CHUNK_ROWS))
    chunks = chunked(counted, [], order_columns(columns), parts)
    sizes = chunks.groupBy(CHUNK).agg(*[F.sum(f"__n_{s}").alias(f"__n_{s}") for s in sides])
    # one row per partition: the only place where a window without keys is harmless
    before = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col(CHUNK).alias("__c"), *[F.coalesce(F.sum(f"__n_{s}").over(before), F.lit(0)).alias(f"__off_{s}") for s in sides]
    )
    local = Window.partitionBy(CHUNK).orderBy(INDEX).rowsBetween(Window.unboundedPreceding, 0)
    placed = chunks.join(F.broadcast(offsets), chunks[CHUNK] == offsets["__c"])
    ends = {f"__to_{s}": F.col(f"__off_{s}") + F.sum(f"__n_{s}").over(local) for s in sides}
    return placed.withColumns(ends).select(
        F.struct(*[F.col(quoted(c)) for c in columns]).alias("row"),
        *[c for s in sides for c in ((F.col(f"__to_{s}") - F.col(f"__n_{s}")).alias(f"from_{s}"), F.col(f"__to_{s}").alias(f"to_{s}"))],
    )


def _differing(reference: DataFrame, candidate: DataFrame, columns: Sequence[str], rows: int) -> DataFrame:
    """``start, stop, r, c``: ranges of positions and the row one side has there, where the sides differ."""
    by = [F.col(quoted(c)) for c in columns]

    def one_side(df: DataFrame, side: str) -> DataFrame:
        counted = df.groupBy(*by).agg(F.count(F.lit(1)).alias(f"__n_{side}"))
        ranges = _ranges(counted, columns, side, rows)
        return ranges.filter(f"to_{side} > from_{side}").selectExpr(
            f"from_{side} AS start", f"to_{side} AS stop", f"row AS {side}"
        )

    if [reference.schema[c].dataType for c in columns] != [candidate.schema[c].dataType for c in columns]:
        # rows of two types are ordered and counted each by their own
        return one_side(reference, "r").unionByName(one_side(candidate, "c"), allowMissingColumns=True)
    sides = [df.select(*by, F.lit(i).alias("__c")) for i, df in enumerate((reference, candidate))]
    counted = sides[0].unionByName(sides[1]).groupBy(*by).agg(F.sum(1 - F.col("__c")).alias("__n_r"), F.sum("__c").alias("__n_c"))
    ranges = _ranges(counted, columns, "rc", 2 * rows)
    cuts = []
    for own, other in ("rc", "cr"):
        here = [f"if({str(s == own).lower()}, row, NULL) AS {s}" for s in "rc"]
        for start, stop in (
            (f"from_{own}", f"least(to_{own}, from_{other})"),
            (f"greatest(from_{own}, to_{other})", f"to_{own}"),
        ):
            cuts.append(f"struct({start} AS start, {stop} AS stop, {', '.join(here)})")
    return ranges.filter("from_r <> from_c OR to_r <> to_c").selectExpr(
        f"inline(filter(array({', '.join(cuts)}), x -> x.stop > x.start))"
    )


def aligned(
    reference: DataFrame, candidate: DataFrame, columns: Sequence[str], block: int = BLOCK
) -> DataFrame:
    """``pos, n, r, c``: from position pos on, n rows are ``r`` in the reference and ``c`` in the candidate.

    Positions at which both sides hold the same row are left out.
    """
    ranges = _differing(reference, candidate, columns, reference.count())
    first, last = F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block)
    cut = ranges.withColumn("block", F.explode(F.sequence(first, last)))
    both = cut.select(
        "block", "r", "c", F.greatest(F.col("start"), F.col("block") * block).alias("pos"),
        F.least(F.col("stop"), (F.col("block") + 1) * block).alias("stop"),
    ).selectExpr("*", "if(r IS NULL, NULL, stop) AS stop_r", "if(c IS NULL, NULL, stop) AS stop_c")
    # both sides cover the same positions, and the frame ends with the last row of the same position
    so_far = Window.partitionBy("block").orderBy("pos")
    known = {x: F.last(x, ignorenulls=True).over(so_far) for x in ("r", "c", "stop_r", "stop_c")}
    filled = both.withColumns({**known, "before": F.lag("pos").over(so_far)})
    return filled.filter("before IS NULL OR before <> pos").selectExpr(
        "pos", "least(stop_r, stop_c) - pos AS n", "r", "c"
    )
