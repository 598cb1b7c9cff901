"""Joins as ``pandas.merge`` has them: missing keys match, key types must agree, columns get suffixes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parity.functions.types import dtype_family, normalize, quoted
from parity.operators.skew import MAX_GROUP_ROWS, broadcastable, has_hot_group

JOIN_TYPES = ("inner", "left", "right", "outer", "cross", "semi", "anti")


class JoinKeyError(ValueError):
    """The declared keys cannot be joined."""


def check_keys(
    left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str]
) -> None:
    """Key lists must have the same length and agree in type family, pair by pair."""
    if not left_on or len(left_on) != len(right_on):
        raise JoinKeyError(f"key lists differ in length: {list(left_on)} and {list(right_on)}")
    for a, b in zip(left_on, right_on, strict=True):
        fa, fb = dtype_family(left.schema[a].dataType), dtype_family(right.schema[b].dataType)
        numeric = {"integer", "float", "boolean"}
        if fa != fb and not {fa, fb} <= numeric:
            raise JoinKeyError(f"cannot join {a} ({fa}) with {b} ({fb})")


def null_safe(pairs: Sequence[tuple[Column, Column]]) -> Column:
    """Conjunction of null-safe equalities; still planned as a hash or sort-merge equi-join."""
    return reduce(lambda a, b: a & b, (x.eqNullSafe(y) for x, y in pairs))


def _output_names(
    left: DataFrame,
    right: DataFrame,
    left_on: Sequence[str],
    right_on: Sequence[str],
    suffixes: tuple[str, str],
) -> tuple[dict[str, str], dict[str, str], set[str]]:
    shared = {a for a, b in zip(left_on, right_on, strict=True) if a == b}
    overlap = (set(left.columns) & set(right.columns)) - shared
    left_names = {c: c + suffixes[0] if c in overlap else c for c in left.columns}
    right_names = {c: c + suffixes[1] if c in overlap else c for c in right.columns if c not in shared}
    return left_names, right_names, shared


def _prefixed(df: DataFrame, prefix: str, marker: str | None) -> DataFrame:
    """Columns renamed apart from the other side's, and a marker that is missing on padded rows."""
    renamed = df.toDF(*[prefix + c for c in df.columns])
    return renamed.withColumn(marker, F.lit(True)) if marker else renamed


def join(
    left: DataFrame,
    right: DataFrame,
    how: str = "inner",
    left_on: Sequence[str] = (),
    right_on: Sequence[str] | None = None,
    suffixes: tuple[str, str] = ("_x", "_y"),
    indicator: bool = False,
    broadcast: str = "auto",
    max_group_rows: int | None = MAX_GROUP_ROWS,
) -> DataFrame:
    """``pd.merge``.

    Keys of the same name come out once; keys of different names come out both.

    ``broadcast``: "auto" leaves the choice to adaptive execution, which measures the side at run
    time; "right" hints the right side, and raises unless its size is known to be under the limit.

    Adaptive execution splits a hot key of an inner join, but not on the side whose rows an outer join
    may pad. When that side has a key with more than ``max_group_rows`` rows, the outer join is
    planned as the inner join plus the unmatched rows, found against the distinct keys.
    """
    if how not in JOIN_TYPES:
        raise ValueError(f"how must be one of {JOIN_TYPES}")
    left, right = normalize(left), normalize(right)
    if how == "cross":
        return cross(left, right, suffixes)
    right_on = list(left_on if right_on is None else right_on)
    left_on = list(left_on)
    check_keys(left, right, left_on, right_on)
    if broadcast == "right":
        if not broadcastable(right):
            raise ValueError("the right side is not known to be under the broadcast limit")
        right = F.broadcast(right)

    if how in ("semi", "anti"):
        # distinct, so that a key with very many rows on the right is one row and not one task
        keys = right.select(*[F.col(b).alias(f"__r{i}") for i, b in enumerate(right_on)]).distinct()
        pairs = [(left[a], keys[f"__r{i}"]) for i, a in enumerate(left_on)]
        return left.join(keys, null_safe(pairs), f"left_{how}")

    left_names, right_names, shared = _output_names(left, right, left_on, right_on, suffixes)
    marked = indicator or how == "outer"
    lhs = _prefixed(left, "__l_", "__in_l" if marked else None)
    rhs = _prefixed(right, "__r_", "__in_r" if marked else None)
    lkeys, rkeys = [f"__l_{c}" for c in left_on], [f"__r_{c}" for c in right_on]
    condition = F.expr(
        " AND ".join(f"{quoted(a)} <=> {quoted(b)}" for a, b in zip(lkeys, rkeys, strict=True))
    )

    padded = {"left": [(rhs, rkeys)], "right": [(lhs, lkeys)], "outer": [(lhs, lkeys), (rhs, rkeys)]}
    if any(has_hot_group(side, keys, max_group_rows) for side, keys in padded.get(how, [])):
        joined = _split_outer(lhs, rhs, lkeys, rkeys, condition, how)
    else:
        joined = lhs.join(rhs, condition, {"outer": "full"}.get(how, how))

    columns = []
    for source, target in left_names.items():
        value, other = quoted(f"__l_{source}"), quoted(f"__r_{source}")
        if source in shared and how == "right":
            value = other
        elif source in shared and how == "outer":
            value = f"if(__in_l, {value}, {other})"
        columns.append(f"{value} AS {quoted(target)}")
    columns += [f"{quoted(f'__r_{source}')} AS {quoted(target)}" for source, target in right_names.items()]
    if indicator:
        columns.append(
            "CASE WHEN __in_l IS NULL THEN 'right_only' WHEN __in_r IS NULL THEN 'left_only' ELSE 'both' END AS _merge"
        )
    return joined.selectExpr(*columns)


def _split_outer(
    lhs: DataFrame, rhs: DataFrame, lkeys: list[str], rkeys: list[str], condition: Column, how: str
) -> DataFrame:
    """Outer join as the inner join plus unmatched rows; no step keeps a hot key in one task."""
    joined = lhs.join(rhs, condition, "inner")
    if how in ("left", "outer"):
        lonely = lhs.join(rhs.select(*rkeys).distinct(), condition, "left_anti")
        joined = joined.unionByName(lonely, allowMissingColumns=True)
    if how in ("right", "outer"):
        lonely = rhs.join(lhs.select(*lkeys).distinct(), condition, "left_anti")
        joined = joined.unionByName(lonely, allowMissingColumns=True)
    return joined


def cross(
    left: DataFrame, right: DataFrame, suffixes: tuple[str, str] = ("_x", "_y")
) -> DataFrame:
    """``how="cross"``: every pair. A side measured to be small is sent to every task; of two large sides every
    pair of partitions is a task."""
    if broadcastable(right):
        right = F.broadcast(right)
    elif broadcastable(left):
        left = F.broadcast(left)
    overlap = set(left.columns) & set(right.columns)
    lhs = left.withColumnsRenamed({c: c + suffixes[0] for c in overlap})
    rhs = right.withColumnsRenamed({c: c + suffixes[1] for c in overlap})
    return lhs.crossJoin(rhs)


def keyed_difference(
    reference: DataFrame, candidate: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Keys present on one side only, with the side. Each side is reduced to distinct keys first."""
    sides = [
        normalize(frame).select(*keys).distinct().withColumn("__side", F.lit(side))
        for frame, side in ((reference, 1), (candidate, 2))
    ]
    return (
        sides[0]
        .unionByName(sides[1])
        .groupBy(*keys)
        .agg(F.sum("__side").alias("__sides"))
        .filter(F.col("__sides") < 3)
        .select(
            *keys,
            F.when(F.col("__sides") == 1, "left_only").otherwise("right_only").alias("_merge"),
        )
    )


def fanout_report(
    left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str] | None = None
) -> DataFrame:
    """What an inner join would do, from key counts alone: rows, duplicate keys, predicted output rows."""
    right_on = list(left_on if right_on is None else right_on)
    check_keys(left, right, left_on, right_on)
    names = [f"__k{i}" for i in range(len(right_on))]

    def counts(df: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
        rows = normalize(df).select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)])
        return rows.groupBy(*names).agg(
            F.sum(F.lit(1 if side == "l" else 0)).alias("l"),
            F.sum(F.lit(0 if side == "l" else 1)).alias("r"),
        )

    both = counts(left, left_on, "l").unionByName(counts(right, right_on, "r"))
    per_key = both.groupBy(*names).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return per_key.agg(
        F.coalesce(F.sum("l"), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("right_rows"),
        F.coalesce(F.sum(F.greatest(F.col("l") - 1, F.lit(0))), F.lit(0)).alias("left_duplicates"),
        F.coalesce(F.sum(F.greatest(F.col("r") - 1, F.lit(0))), F.lit(0)).alias("right_duplicates"),
        F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0)).alias("predicted_rows"),
    )
