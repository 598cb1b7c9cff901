"""Group aggregation and pivots with pandas semantics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parity.functions.types import normalize
from parity.operators.frame import sort_values


def _aggregate(df: DataFrame, column: str, fn: str) -> Column:
    c = F.col(column)
    if fn == "sum":
        zero = F.lit(0).cast(df.schema[column].dataType)
        return F.coalesce(F.sum(c), zero)
    if fn == "mean":
        return F.avg(c)
    if fn == "count":
        return F.count(c)
    if fn == "min":
        return F.min(c)
    if fn == "max":
        return F.max(c)
    if fn == "nunique":
        return F.count_distinct(c)
    if fn == "approx_nunique":
        return F.approx_count_distinct(c)
    raise ValueError(f"unknown aggregate {fn!r}")


def present(keys: Sequence[str]) -> Column:
    """True where no key is missing."""
    return reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))


def groupby_agg(
    df: DataFrame,
    keys: Sequence[str],
    aggregates: Mapping[str, tuple[str, str]],
    dropna: bool = True,
    sort: bool = False,
) -> DataFrame:
    """``groupby(keys).agg(...)``.

    Rows with a missing key are left out unless ``dropna=False``; a sum over no values is 0. Every
    output is named. With no keys it is the global aggregate.
    """
    df = normalize(df)
    columns = [_aggregate(df, c, fn).alias(out) for out, (c, fn) in aggregates.items()]
    if not keys:
        return df.agg(*columns)
    source = df.filter(present(keys)) if dropna else df
    grouped = source.groupBy(*keys).agg(*columns)
    return sort_values(grouped, keys) if sort else grouped


def pivot_table(
    df: DataFrame,
    index: Sequence[str],
    columns: str,
    values: str,
    labels: Sequence[str],
    fn: str = "mean",
) -> DataFrame:
    """``pivot_table``: one output column per label; cells without rows are null."""
    df = normalize(df)
    source = df.filter(present([*index, columns]))
    return source.groupBy(*index).pivot(columns, list(labels)).agg(_aggregate(df, values, fn))


def pivot(
    df: DataFrame, index: Sequence[str], columns: str, values: str, labels: Sequence[str]
) -> DataFrame:
    """``pivot``: as above without aggregation. A second value for a cell raises when the cell is computed."""
    kept = normalize(df).filter(F.col(columns).isin(list(labels)))
    cell = F.when(
        F.count(F.lit(1)) > 1,
        F.raise_error(F.lit("index contains duplicate entries, cannot reshape")).cast(
            df.schema[values].dataType
        ),
    ).otherwise(F.first(values))
    return kept.groupBy(*index).pivot(columns, list(labels)).agg(cell)


def labels_of(df: DataFrame, column: str, limit: int | None = None) -> list:
    """The labels of a pivot column, for callers that do not know them. A ``limit`` makes more labels an error."""
    labels = normalize(df).select(column).filter(F.col(column).isNotNull()).distinct()
    found = (labels if limit is None else labels.limit(limit + 1)).collect()
    if limit is not None and len(found) > limit:
        raise ValueError(f"{column} has more than {limit} labels; a pivot needs a bounded set")
    return sorted(row[0] for row in found)

