"""Column and dataset statistics, shared by the comparison and the profiler."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parity.functions.types import double_sql, is_numeric, literal_sql, quoted, text_sql


def literal_rows(spark: SparkSession, schema: str, rows: Sequence[tuple]) -> DataFrame:
    """A small frame of constants that stays inside the plan."""
    fields = T.StructType.fromDDL(schema).fields
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
    structs = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields, strict=True)])
        for row in rows
    ]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))


def _md5_number(text: str) -> str:
    """60 bits of the MD5 as a number, reproducible in other engines."""
    return f"CAST(conv(substring(md5({text}), 1, 15), 16, 10) AS DECIMAL(38, 0))"


def _fast_number(text: str) -> str:
    return f"CAST(xxhash64({text}) AS DECIMAL(38, 0))"


def measures(df: DataFrame, columns: Sequence[str], portable_checksum: bool = True) -> DataFrame:
    """Everything that one pass over the frame can tell about its columns, one row per column.

    ``column, ordinal, dtype, is_numeric, row_count, null_count, total, low, high, mean, checksum,
    low_text, high_text``. The checksum of a column is the sum of its values' hashes: it does not
    depend on order and needs no sort.
    """
    if not columns:
        raise ValueError("no columns to measure")
    number = _md5_number if portable_checksum else _fast_number
    types = {f.name: f.dataType for f in df.schema.fields}
    aggregates, rows = ["count(1) AS rows"], []
    for i, name in enumerate(columns):
        c, dtype = quoted(name), types[name]
        numeric = is_numeric(dtype)
        text = text_sql(c, dtype)
        low = text if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)) else c
        aggregates += [f"count({c}) AS n{i}", f"min({low}) AS l{i}", f"max({low}) AS h{i}"]
        aggregates.append(f"coalesce(sum({number(text)}), 0) AS k{i}")
        if numeric:
            aggregates += [f"sum({double_sql(c, dtype)}) AS s{i}", f"avg({double_sql(c, dtype)}) AS a{i}"]
        facts = {
            "column": literal_sql(name), "ordinal": str(i), "dtype": literal_sql(dtype.simpleString()),
            "is_numeric": str(numeric).lower(), "row_count": "rows", "null_count": f"rows - n{i}",
            "total": f"s{i}" if numeric else "CAST(NULL AS DOUBLE)",
            "low": double_sql(f"l{i}", dtype) if numeric else "CAST(NULL AS DOUBLE)",
            "high": double_sql(f"h{i}", dtype) if numeric else "CAST(NULL AS DOUBLE)",
            "mean": f"a{i}" if numeric else "CAST(NULL AS DOUBLE)",
            "checksum": f"CAST(k{i} AS DECIMAL(38, 0))",
            "low_text": f"CAST(l{i} AS STRING)", "high_text": f"CAST(h{i} AS STRING)",
        }
        rows.append("struct(" + ", ".join(f"{v} AS {k}" for k, v in facts.items()) + ")")
    return df.selectExpr(*aggregates).selectExpr(f"inline(array({', '.join(rows)}))")


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact distinct non-null values per column: ``column, distinct_count``.

    Two levels of grouping, both combined before their shuffle: values first, then their number.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    cells = ", ".join(
        f"struct({i} AS ordinal, {text_sql(quoted(c), types[c])} AS value)" for i, c in enumerate(columns)
    )
    values = df.selectExpr(f"inline(array({cells}))").filter("value IS NOT NULL").distinct()
    names = ", ".join(literal_sql(c) for c in columns)
    counts = values.groupBy("ordinal").agg(F.count(F.lit(1)).alias("distinct_count"))
    return counts.selectExpr(f"array({names})[ordinal] AS column", "distinct_count")


def column_stats(df: DataFrame) -> DataFrame:
    """``column, dtype, null_count, distinct_count, numeric_sum, numeric_min, numeric_max``."""
    one_pass, distinct = measures(df, df.columns), distinct_counts(df, df.columns)
    return one_pass.join(distinct, "column", "left").select(
        "column",
        "dtype",
        "null_count",
        F.coalesce("distinct_count", F.lit(0)).alias("distinct_count"),
        F.col("total").alias("numeric_sum"),
        F.col("low").alias("numeric_min"),
        F.col("high").alias("numeric_max"),
    )


def duplicate_count(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Rows that repeat an earlier one on the columns; a missing value equals a missing value."""
    copies = df.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count(F.lit(1)).alias("__n"))
    return copies.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias(name),
    )


def dataset_stats(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row: ``row_count, duplicate_row_count, duplicate_key_count``."""
    rows = duplicate_count(df, df.columns, "duplicate_row_count")
    usable = [k for k in keys if k in df.columns]
    if not usable:
        return rows.withColumn("duplicate_key_count", F.lit(0).cast("bigint"))
    by_key = duplicate_count(df, usable, "duplicate_key_count").drop("row_count")
    parts = rows.unionByName(by_key, allowMissingColumns=True)
    return parts.agg(*[F.max(c).alias(c) for c in (*rows.columns, "duplicate_key_count")])


def has_duplicates(df: DataFrame, columns: Sequence[str]) -> bool:
    return not df.groupBy(*columns).count().filter(F.col("count") > 1).limit(1).isEmpty()
