"""Dataset profiles: sizes, missing and distinct values, ranges, examples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parity.functions.types import literal_sql, normalize, quoted, text_sql
from parity.operators.compare import samples
from parity.operators.skew import BROADCAST_LIMIT_BYTES
from parity.operators.stats import distinct_counts, literal_rows, measures
from parity.sources.datasets import DatasetError, DatasetFile, find_dataset, load_found, scan_directory

MAX_EXAMPLES = 3

PROFILE = (
    "path string, format string, exists boolean, row_count bigint, sampled boolean, "
    "size_bytes bigint, column_count int, error string"
)

COLUMN_PROFILE = (
    "column string, ordinal int, dtype string, null_count bigint, null_fraction double, distinct_count bigint, "
    "min_value string, max_value string, examples array<string>"
)


def examples(df: DataFrame, columns: Sequence[str], n: int = MAX_EXAMPLES) -> DataFrame:
    """The n smallest distinct values per column as text: ``column, examples``.

    Distinct values are found map-side first, and each task then sends at most n per column.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    cells = ", ".join(
        f"struct({literal_sql(c)} AS column, {text_sql(quoted(c), types[c])} AS value)" for c in columns
    )
    values = df.selectExpr(f"inline(array({cells}))").filter("value IS NOT NULL").distinct()
    few = samples(values, ["column"], ["value"], n)
    return few.groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("examples"))


def profile_columns(df: DataFrame, n_examples: int = MAX_EXAMPLES) -> DataFrame:
    """One row per column: ``column, dtype, null_count, null_fraction, distinct_count, min_value,
    max_value, examples``. NaN counts as missing."""
    df = normalize(df)
    one_pass = measures(df, df.columns)
    distinct = distinct_counts(df, df.columns)
    few = examples(df, df.columns, n_examples)
    rows = F.col("row_count")
    return (
        one_pass.join(distinct, "column", "left")
        .join(few, "column", "left")
        .select(
            "column",
            "ordinal",
            "dtype",
            "null_count",
            F.when(rows > 0, F.col("null_count") / rows).otherwise(0.0).alias("null_fraction"),
            F.coalesce("distinct_count", F.lit(0)).alias("distinct_count"),
            F.col("low_text").alias("min_value"),
            F.col("high_text").alias("max_value"),
            F.coalesce("examples", F.array().cast("array<string>")).alias("examples"),
        )
    )


def profile_found(spark: SparkSession, dataset: DatasetFile, sample_rows: int | None = None) -> DataFrame:
    """One row about a dataset. An error is a value of the profile, not an exception."""
    try:
        df = load_found(spark, dataset)
    except Exception as exc:  # noqa: BLE001 - whatever the reader says goes into the profile
        row = (dataset.path, dataset.format, False, 0, False, 0, 0, str(exc))
        return literal_rows(spark, PROFILE, [row])
    counted = (df.limit(sample_rows + 1) if sample_rows else df).agg(F.count(F.lit(1)).alias("n"))
    limit = F.lit(sample_rows if sample_rows else (1 << 62)).cast("bigint")
    return counted.select(
        F.lit(dataset.path).alias("path"),
        F.lit(dataset.format).alias("format"),
        F.lit(True).alias("exists"),
        F.least("n", limit).alias("row_count"),
        (F.col("n") > limit).alias("sampled"),
        F.lit(dataset.size_bytes).cast("bigint").alias("size_bytes"),
        F.lit(len(df.columns)).alias("column_count"),
        F.lit(None).cast("string").alias("error"),
    )


def profile_dataset(spark: SparkSession, path: str, sample_rows: int | None = None) -> DataFrame:
    try:
        found = find_dataset(spark, path)
    except DatasetError as exc:
        row = (path, "unknown", False, 0, False, 0, 0, str(exc))
        return literal_rows(spark, PROFILE, [row])
    return profile_found(spark, found, sample_rows)


def profile_directory(spark: SparkSession, path: str, sample_rows: int | None = None) -> DataFrame:
    """One row per readable dataset of a directory, by path."""
    profiles = [profile_found(spark, d, sample_rows) for d in scan_directory(spark, path)]
    if not profiles:
        return literal_rows(spark, PROFILE, [])
    union = profiles[0]
    for p in profiles[1:]:
        union = union.unionByName(p)
    return union.orderBy("path")


def profile_directory_columns(spark: SparkSession, path: str) -> DataFrame:
    """The column profiles of every readable dataset of a directory, with its ``path``."""
    profiles = [
        profile_columns(load_found(spark, d)).withColumn("path", F.lit(d.path)) for d in scan_directory(spark, path)
    ]
    return reduce(DataFrame.unionByName, profiles) if profiles else literal_rows(spark, f"{COLUMN_PROFILE}, path string", [])


def with_broadcast_candidates(profiles: DataFrame) -> DataFrame:
    """Flag datasets small enough to broadcast."""
    size = F.col("size_bytes")
    return profiles.withColumn(
        "broadcast_candidate", F.col("exists") & (size > 0) & (size < BROADCAST_LIMIT_BYTES)
    )


def size_report(profiles: DataFrame) -> DataFrame:
    return with_broadcast_candidates(profiles).select(
        "path", "row_count", "size_bytes", "broadcast_candidate"
    )


def schema_fields(profile: DataFrame) -> DataFrame:
    """Column specifications from a profile: nullable means a missing value was seen."""
    return profile.select(
        "column", "ordinal", "dtype", (F.col("null_count") > 0).alias("nullable"), "examples"
    )


def schema_from_profile(profile: DataFrame) -> T.StructType:
    """The same as a schema. One row per column comes to the driver, as any schema does."""
    rows = schema_fields(profile).orderBy("ordinal").collect()
    return T.StructType(
        [T.StructField(r["column"], T.DataType.fromDDL(r["dtype"]), r["nullable"]) for r in rows]
    )
