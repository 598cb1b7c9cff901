"""Families that column types are compared and chosen by, SQL text forms of values, and one form of missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dtype_family(dtype: T.DataType) -> str:
    """Coarse family of a Spark type; any other type is its own family."""
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "timestamp"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    return dtype.simpleString()


def is_numeric(dtype: T.DataType) -> bool:
    """Numeric in the pandas sense: booleans count."""
    return dtype_family(dtype) in ("boolean", "integer", "float")


def quoted(name: str) -> str:
    """A column name in SQL text."""
    return "`" + name.replace("`", "``") + "`"


def literal_sql(text: str) -> str:
    """A string literal in SQL text."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def double_sql(sql: str, dtype: T.DataType) -> str:
    """A numeric or boolean value as double."""
    inner = f"CAST({sql} AS INT)" if isinstance(dtype, T.BooleanType) else sql
    return f"CAST({inner} AS DOUBLE)"


def text_sql(sql: str, dtype: T.DataType) -> str:
    """Injective text form of a value: equal text exactly when the values are equal."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return f"CAST({sql} + CAST(0 AS {dtype.simpleString()}) AS STRING)"  # -0.0 is 0.0
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return f"to_json({sql})"
    if isinstance(dtype, T.BinaryType):
        return f"hex({sql})"
    return f"CAST({sql} AS STRING)"


def has_floats(df: DataFrame) -> bool:
    return any(isinstance(f.dataType, (T.FloatType, T.DoubleType)) for f in df.schema.fields)


def normalize(df: DataFrame) -> DataFrame:
    """NaN to null in every float column, so that one missing value remains, as in pandas."""
    floats = {
        f.name: F.nanvl(F.col(f"`{f.name}`"), F.lit(None).cast(f.dataType))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.FloatType, T.DoubleType))
    }
    return df.withColumns(floats) if floats else df
