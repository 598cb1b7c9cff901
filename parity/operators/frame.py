"""Row-wise operators: projection, derived columns, missing values, casts, order, union."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parity.functions.types import dtype_family, normalize


def select(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def drop(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Remove columns; a name that does not exist raises, as in pandas."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")
    return df.drop(*columns)


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def derive(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """``assign`` for several columns in one projection.

    The expressions see missing values as null: the floor, ceiling or integer cast of a NaN would be 0.
    ANSI arithmetic raises on overflow; use :func:`try_multiply` and friends where the job being
    replaced went on with a missing value.
    """
    return normalize(df).withColumns(dict(columns))


def try_add(a: Column, b: Column) -> Column:
    return F.try_add(a, b)


def try_multiply(a: Column, b: Column) -> Column:
    return F.try_multiply(a, b)


def try_divide(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def _fill_literal(field: T.StructField, value: Any) -> Column | None:
    family = dtype_family(field.dataType)
    if isinstance(value, bool):
        fits = family == "boolean"
    elif isinstance(value, int):
        fits = family in ("integer", "float")
    elif isinstance(value, float):
        fits = family == "float" or (family == "integer" and value.is_integer())
    elif isinstance(value, str):
        fits = family == "string"
    else:
        fits = family == "timestamp"
    return F.lit(value).cast(field.dataType) if fits else None


def fillna(df: DataFrame, value: Any) -> DataFrame:
    """Fill missing values, NaN included, in every column (scalar) or in the named ones (dict).

    A value that does not fit a column's type family raises: pandas would turn the column into one
    of mixed objects, which a typed frame cannot hold.
    """
    wanted = dict(value) if isinstance(value, Mapping) else {f.name: value for f in df.schema.fields}
    filled = {}
    for field in df.schema.fields:
        if field.name not in wanted:
            continue
        literal = _fill_literal(field, wanted[field.name])
        if literal is None:
            raise TypeError(
                f"cannot fill {field.name} ({field.dataType.simpleString()}) with {wanted[field.name]!r}"
            )
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            column = F.nanvl(column, F.lit(None).cast(field.dataType))
        filled[field.name] = F.coalesce(column, literal)
    return df.withColumns(filled) if filled else df


def dropna(
    df: DataFrame,
    how: str = "any",
    subset: Sequence[str] | None = None,
    thresh: int | None = None,
) -> DataFrame:
    """Drop rows by their missing values (null or NaN); those that stay come out as null. The rows are dropped before
    that, so that the scan can push the condition down."""
    return normalize(df.na.drop(how=how, thresh=thresh, subset=list(subset) if subset else None))


def astype(df: DataFrame, types: Mapping[str, str], errors: str = "raise") -> DataFrame:
    """Cast columns. Floats truncate toward zero; ``errors`` decides whether a bad value raises."""
    if errors not in ("raise", "null"):
        raise ValueError("errors must be 'raise' or 'null'")
    casts = {}
    for name, target in types.items():
        column = F.col(f"`{name}`")
        if errors == "null":
            casts[name] = column.try_cast(target)
            continue
        cast = column.cast(target)
        source = df.schema[name].dataType
        target_type = T.DataType.fromDDL(target)
        if dtype_family(target_type) == "integer" and dtype_family(source) in ("float", "integer"):
            missing = column.isNull()
            if isinstance(source, (T.FloatType, T.DoubleType)):
                missing = missing | F.isnan(column)
            message = F.lit(f"cannot convert a missing value in {name} to {target}")
            cast = F.when(missing, F.raise_error(message).cast(target)).otherwise(cast)
        casts[name] = cast
    return df.withColumns(casts)


def reset_index(df: DataFrame) -> DataFrame:
    """Nothing to do: a Spark frame has no index, and inventing one would add a column."""
    return df


def order_columns(by: Sequence[str], ascending: bool | Sequence[bool] = True) -> list[Column]:
    """Sort keys with missing values last in either direction."""
    directions = [ascending] * len(by) if isinstance(ascending, bool) else list(ascending)
    if len(directions) != len(by):
        raise ValueError("ascending must name one direction per key")
    return [
        F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last()
        for c, up in zip(by, directions, strict=True)
    ]


def sort_values(
    df: DataFrame,
    by: Sequence[str],
    ascending: bool | Sequence[bool] = True,
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """``sort_values``: a range-partitioned sort, missing values last, ties by ``tiebreak``."""
    return normalize(df).orderBy(*order_columns(by, ascending), *order_columns(tiebreak))


def head(
    df: DataFrame,
    n: int,
    by: Sequence[str],
    ascending: bool | Sequence[bool] = True,
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """First n rows in a declared order; planned as a top-n per task, then one merge."""
    return sort_values(df, by, ascending, tiebreak).limit(n)


def concat(*frames: DataFrame) -> DataFrame:
    """Union all by column name. A column some frame lacks is filled with nulls and, if integer, widened."""
    names = list(dict.fromkeys(c for f in frames for c in f.columns))
    partial = {c for c in names if any(c not in f.columns for f in frames)}

    def widened(frame: DataFrame) -> DataFrame:
        casts = {
            f.name: F.col(f"`{f.name}`").cast("double")
            for f in frame.schema.fields
            if f.name in partial and dtype_family(f.dataType) == "integer"
        }
        return frame.withColumns(casts) if casts else frame

    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), (widened(f) for f in frames)
    )


def map_values(column: Column, mapping: Mapping[Any, Any]) -> Column:
    """``Series.map(dict)`` for a dict written in the program: one literal map, unknown values null."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), column)


def map_lookup(df: DataFrame, column: str, lookup: DataFrame, output: str) -> DataFrame:
    """``Series.map`` against a (key, value) table: a left join that keeps every row."""
    key, value = lookup.columns
    table = lookup.select(F.col(key).alias("__key"), F.col(value).alias(output))
    return df.join(table, df[column].eqNullSafe(F.col("__key")), "left").drop("__key")


def apply_series(column: Column, fn, return_type: str) -> Column:
    """``Series.apply`` for a vectorised Python function, in Arrow batches; nullable result."""

    def batch(values: pd.Series) -> pd.Series:
        return fn(values)

    return F.pandas_udf(batch, return_type)(column)


def apply_rows(df: DataFrame, columns: Sequence[str], fn, return_type: str) -> Column:
    """``DataFrame.apply(axis=1)`` for a function of a batch frame, in Arrow batches."""

    def batch(rows: pd.DataFrame) -> pd.Series:
        return fn(rows)

    batch.__annotations__ = {"rows": pd.DataFrame, "return": pd.Series}
    return F.pandas_udf(batch, return_type)(F.struct(*[df[c] for c in columns]))

