"""Ordered windows with pandas semantics, and deduplication by an explicit order.

Each function needs ``partition_by`` and ``order_by``: pandas takes its order from the index, and a
Spark frame has none. Ordinarily one window per group is planned. When a group is measured to be
larger than ``max_group_rows`` the rows are laid out in range-partitioned chunks instead, every chunk
is processed on its own, and the state of the chunks before it is carried over.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parity.functions.types import normalize
from parity.operators.frame import order_columns
from parity.operators.joins import null_safe
from parity.operators.positions import CHUNK, INDEX, carries, chunked, with_carries, with_positions
from parity.operators.skew import MAX_GROUP_ROWS, has_hot_group

ROLLING = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}


def _required(partition_by: Sequence[str], order_by: Sequence[str]) -> None:
    if not partition_by or not order_by:
        raise ValueError("a window needs partition_by and order_by")


def _blocks(
    df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str], size: int, reach: int
) -> tuple[DataFrame, Window]:
    """Cut large groups into blocks of ``size`` positions, each with copies of its neighbour's rows.

    ``reach`` > 0 repeats that many rows from before the block, < 0 from after it.
    """
    placed = with_positions(df, partition_by, order_columns(order_by))
    within = F.pmod(F.col("__pos"), F.lit(size))
    block = F.floor(F.col("__pos") / F.lit(size))
    near = within >= size - reach if reach > 0 else within < -reach
    rows = placed.withColumns({"__block": block, "__halo": F.lit(False)})
    halo = placed.filter(near).withColumns(
        {"__block": block + (1 if reach > 0 else -1), "__halo": F.lit(True)}
    )
    together = rows.unionByName(halo) if reach else rows
    return together, Window.partitionBy(*partition_by, "__block").orderBy("__pos")


def _without_blocks(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("__halo")).drop("__block", "__halo", "__pos")


def rolling(
    df: DataFrame,
    column: str,
    n: int,
    fn: str,
    partition_by: Sequence[str],
    order_by: Sequence[str],
    output: str,
    min_periods: int | None = None,
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """``groupby(...).rolling(n)``: null until ``min_periods`` (n by default) values are in the window."""
    _required(partition_by, order_by)
    df = normalize(df)
    needed = n if min_periods is None else min_periods

    def value(window: Window) -> Column:
        frame = window.rowsBetween(-(n - 1), 0)
        return F.when(F.count(column).over(frame) >= needed, ROLLING[fn](column).over(frame))

    if not has_hot_group(df, partition_by, max_group_rows):
        window = Window.partitionBy(*partition_by).orderBy(*order_columns(order_by))
        return df.withColumn(output, value(window))
    rows, window = _blocks(df, partition_by, order_by, max(max_group_rows, n), n - 1)
    return _without_blocks(rows.withColumn(output, value(window)))


def shift(
    df: DataFrame,
    column: str,
    k: int,
    partition_by: Sequence[str],
    order_by: Sequence[str],
    output: str,
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """``groupby(...).shift(k)``; negative k looks ahead."""
    _required(partition_by, order_by)
    df = normalize(df)

    def value(window: Window) -> Column:
        return F.lag(column, k).over(window) if k >= 0 else F.lead(column, -k).over(window)

    if not has_hot_group(df, partition_by, max_group_rows):
        window = Window.partitionBy(*partition_by).orderBy(*order_columns(order_by))
        return df.withColumn(output, value(window))
    rows, window = _blocks(df, partition_by, order_by, max(max_group_rows, abs(k) + 1), k)
    return _without_blocks(rows.withColumn(output, value(window)))


def _running(
    df: DataFrame,
    column: str,
    fn: str,
    partition_by: Sequence[str],
    order: Sequence[Column],
    output: str,
    max_group_rows: int | None,
) -> DataFrame:
    """Aggregate of a group's rows up to and including each row."""
    if not has_hot_group(df, partition_by, max_group_rows):
        window = Window.partitionBy(*partition_by).orderBy(*order)
        frame = window.rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(output, {**ROLLING, "count": F.count}[fn](column).over(frame))

    chunks = chunked(df, partition_by, order)
    names = {"sum": (F.sum(column), "sum"), "count": (F.count(column), "sum")}
    names |= {"min": (F.min(column), "min"), "max": (F.max(column), "max")}
    wanted = ("sum", "count") if fn == "mean" else (fn,)
    carried = carries(chunks, partition_by, {f"__before_{k}": names[k] for k in wanted})
    frame = (
        Window.partitionBy(*partition_by, CHUNK).orderBy(INDEX).rowsBetween(Window.unboundedPreceding, 0)
    )

    def total(kind: str) -> Column:
        here, before = getattr(F, kind)(column).over(frame), F.col(f"__before_{kind}")
        if kind in ("min", "max"):
            return {"min": F.least, "max": F.greatest}[kind](here, before)
        return F.coalesce(here + before, here, before)

    value = total("sum") / F.nullif(total("count"), F.lit(0)) if fn == "mean" else total(fn)
    rows = with_carries(chunks, partition_by, carried).withColumn(output, value)
    return rows.drop(CHUNK, INDEX, *[f"__before_{k}" for k in wanted])


def expanding(
    df: DataFrame,
    column: str,
    fn: str,
    partition_by: Sequence[str],
    order_by: Sequence[str],
    output: str,
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """``groupby(...).expanding()``: over all rows so far, from the first value on."""
    _required(partition_by, order_by)
    return _running(normalize(df), column, fn, partition_by, order_columns(order_by), output, max_group_rows)


def cumsum(
    df: DataFrame,
    column: str,
    partition_by: Sequence[str],
    order_by: Sequence[str],
    output: str,
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """``groupby(...).cumsum()``: a missing value stays missing and the sum goes on after it."""
    _required(partition_by, order_by)
    summed = _running(normalize(df), column, "sum", partition_by, order_columns(order_by), output, max_group_rows)
    return summed.withColumn(output, F.when(F.col(column).isNotNull(), F.col(output)))


def rank(
    df: DataFrame,
    column: str,
    partition_by: Sequence[str],
    output: str,
    method: str = "average",
    ascending: bool = True,
    order_by: Sequence[str] = (),
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """``groupby(...).rank(method)``: average, min, max, dense or first; a missing value has no rank.

    ``first`` breaks ties by ``order_by``. For a large group the ranks of the distinct values come
    from their counts, which are combined before the shuffle, and are joined back to the rows.
    """
    if not partition_by:
        raise ValueError("a window needs partition_by")
    if method == "first" and not order_by:
        raise ValueError("rank 'first' needs order_by")
    df = normalize(df)
    value_order = order_columns([column], ascending)
    missing = F.col(column).isNull()

    if not has_hot_group(df, partition_by, max_group_rows):
        group = Window.partitionBy(*partition_by, missing)
        ordered = group.orderBy(*value_order)
        if method == "first":
            ranked = F.row_number().over(group.orderBy(*value_order, *order_columns(order_by)))
        elif method == "dense":
            ranked = F.dense_rank().over(ordered)
        else:
            # the default frame ends at the last peer, so its count is the highest rank of the tie
            low, high = F.rank().over(ordered), F.count(F.lit(1)).over(ordered)
            ranked = {"min": low, "max": high, "average": (low + high) / 2}[method]
        return df.withColumn(output, F.when(~missing, ranked.cast("double")))

    if method == "first":
        present = df.filter(~missing)
        placed = with_positions(present, partition_by, [*value_order, *order_columns(order_by)], output)
        ranked = placed.withColumn(output, (F.col(output) + 1).cast("double"))
        return ranked.unionByName(df.filter(missing), allowMissingColumns=True)

    values = (
        df.filter(~missing)
        .groupBy(*partition_by, column)
        .agg(F.count(F.lit(1)).alias("__n"), F.lit(1).alias("__one"))
    )
    measure = "__one" if method == "dense" else "__n"
    totals = _running(values, measure, "sum", partition_by, value_order, "__high", max_group_rows)
    low = F.col("__high") - F.col("__n") + 1
    ranked = {
        "dense": F.col("__high"),
        "max": F.col("__high"),
        "min": low,
        "average": (low + F.col("__high")) / 2,
    }[method]
    table = totals.select(
        *[F.col(k).alias(f"__k_{k}") for k in partition_by],
        F.col(column).alias("__v"),
        ranked.cast("double").alias(output),
    )
    pairs = [(df[k], table[f"__k_{k}"]) for k in partition_by]
    joined = df.join(table, null_safe([*pairs, (df[column], table["__v"])]), "left")
    return joined.drop("__v", *[f"__k_{k}" for k in partition_by])


def drop_duplicates(
    df: DataFrame,
    subset: Sequence[str],
    keep: str | bool = "first",
    order_by: Sequence[str] = (),
) -> DataFrame:
    """``drop_duplicates``: the first or last row by ``order_by``, or (``keep=False``) no copy at all.

    Keeping one row is a row_number filter, which Spark also applies before the shuffle, so that a
    task sends at most one row per key. Dropping all copies carries one row and a count per key.
    """
    df = normalize(df)
    if keep is False:
        others = [c for c in df.columns if c not in subset]
        grouped = df.groupBy(*subset).agg(
            F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in others]
        )
        return grouped.filter(F.col("__n") == 1).select(*df.columns)
    if keep not in ("first", "last"):
        raise ValueError("keep must be 'first', 'last' or False")
    if not order_by:
        raise ValueError("keeping one of several copies needs order_by")
    order = order_columns(order_by)
    if keep == "last":
        order = [F.col(c).desc_nulls_first() for c in order_by]
    number = F.row_number().over(Window.partitionBy(*subset).orderBy(*order))
    return df.withColumn("__rn", number).filter(F.col("__rn") == 1).drop("__rn")
