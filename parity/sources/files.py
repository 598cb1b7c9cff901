"""Readers and writers for the file formats pandas jobs use, typed as pandas would type them."""

from __future__ import annotations

import os
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parity.functions.types import normalize
from parity.sources.split_csv import read_split_csv

# The texts pandas reads as a missing value.
PANDAS_NA = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

#: Suffix to (format, separator). One table for every caller.
FORMATS = {
    ".csv": ("csv", ","),
    ".tsv": ("csv", "\t"),
    ".txt": ("csv", "\t"),
    ".parquet": ("parquet", None),
    ".pq": ("parquet", None),
    ".json": ("json", None),
    ".jsonl": ("json", None),
    ".ndjson": ("json", None),
}

#: Rows of a written CSV part at most.
CSV_PART_ROWS = 1_000_000

WRITE_MODES = ("overwrite", "append", "errorifexists")


def format_of(path: str) -> str:
    """csv, parquet, json or unknown, by suffix."""
    return FORMATS.get(os.path.splitext(path.rstrip("/"))[1].lower(), ("unknown", None))[0]


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | None = None,
    na_values: Sequence[str] = PANDAS_NA,
    sep: str = ",",
    multiline: bool = True,
) -> DataFrame:
    """A header CSV. The texts pandas takes for missing become null, then the columns are cast.

    Without a schema every column is inferred in a second pass as pandas does it: integers, or
    doubles when some are missing, or booleans, else text (dates stay text). Quoted cells may hold
    line breaks, and large files are split all the same (``split_csv``); ``multiline=False`` rules
    such breaks out and saves the pass that looks for them.
    """
    paths = [path] if isinstance(path, str) else list(path)
    return read_csv_groups(spark, [(paths, sep)], schema, na_values, multiline)


def read_csv_groups(
    spark: SparkSession,
    groups: Sequence[tuple[list[str], str]],
    schema: T.StructType | str | None = None,
    na_values: Sequence[str] = PANDAS_NA,
    multiline: bool = True,
) -> DataFrame:
    """Files of one header and separator each, put together by column name before types are inferred."""
    kept = {"nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    if multiline:
        frames = [read_split_csv(spark, paths, sep, **kept) for paths, sep in groups]
    else:
        frames = [spark.read.csv(paths, header=True, sep=sep, escape='"', **kept) for paths, sep in groups]
    raw = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    cleaned = raw.select(
        *[
            F.when(c.isin(list(na_values)), None).otherwise(c).alias(name)
            for name, c in ((n, F.col(f"`{n}`")) for n in raw.columns)
        ]
    )
    if schema is None:
        schema = _infer(cleaned)
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    return cleaned.select(
        *[F.trim(f"`{f.name}`").cast(f.dataType).alias(f.name)
          if not isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
          for f in schema.fields]
    )


def _infer(text: DataFrame) -> T.StructType:
    """One aggregation over all columns; its result is one row."""
    number = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"
    boolean = "^(True|False|TRUE|FALSE|true|false)$"
    facts = []
    for i, name in enumerate(text.columns):
        c = F.col(f"`{name}`")
        # up to 19 digits may fit a long; whether they do, the cast tells
        whole = c.rlike(r"^\s*[+-]?\d{1,19}\s*$") & F.trim(c).try_cast("bigint").isNotNull()
        for label, holds in (("i", whole), ("n", c.rlike(number)), ("b", c.rlike(boolean))):
            facts.append(F.coalesce(F.bool_and(holds), F.lit(False)).alias(f"{label}{i}"))
        facts.append(F.count_if(c.isNull()).alias(f"m{i}"))
        facts.append(F.count(c).alias(f"c{i}"))
    row = text.agg(*facts).first()
    fields = []
    for i, name in enumerate(text.columns):
        missing = row[f"m{i}"] > 0
        if row[f"c{i}"] == 0:
            dtype: T.DataType = T.DoubleType()
        elif row[f"i{i}"]:
            dtype = T.DoubleType() if missing else T.LongType()
        elif row[f"n{i}"]:
            dtype = T.DoubleType()
        elif row[f"b{i}"] and not missing:
            dtype = T.BooleanType()
        else:
            dtype = T.StringType()
        fields.append(T.StructField(name, dtype))
    return T.StructType(fields)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Tab-separated text."""
    return read_csv(spark, path, schema, sep="\t")


def read_parquet(spark: SparkSession, path: str | list[str], merge: bool = False) -> DataFrame:
    """``merge`` takes the columns of all part files, not only those of the first."""
    paths = [path] if isinstance(path, str) else path
    return normalize(spark.read.option("mergeSchema", merge).parquet(*paths))


def read_json(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | None = None,
    lines: bool = True,
) -> DataFrame:
    """JSON lines, or one array document per file."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return normalize(reader.json(path, multiLine=not lines))


def read_sql(
    spark: SparkSession,
    url: str,
    table: str | None = None,
    query: str | None = None,
    column: str | None = None,
    bounds: tuple[object, object] | None = None,
    partitions: int = 1,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """``read_sql`` / ``read_sql_table`` / ``read_sql_query`` over JDBC.

    A table may be read in parallel ranges of a column; a query is one task's work in the database.
    """
    if (table is None) == (query is None):
        raise ValueError("name either a table or a query")
    reader = spark.read.format("jdbc").option("url", url).options(**(properties or {}))
    if query is not None:
        return reader.option("query", query).load()
    reader = reader.option("dbtable", table)
    if column is not None:
        if bounds is None:
            raise ValueError("a partitioned read needs bounds")
        reader = (
            reader.option("partitionColumn", column)
            .option("lowerBound", str(bounds[0]))
            .option("upperBound", str(bounds[1]))
            .option("numPartitions", str(partitions))
        )
    return reader.load()


def _writer(df: DataFrame, mode: str):
    if mode not in WRITE_MODES:
        raise ValueError(f"mode must be one of {WRITE_MODES}")
    return df.write.mode(mode)


def to_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A header CSV as a directory of part files; never forced into one, and small enough to be read whole where
    cells hold line breaks."""
    writer = _writer(df, mode).option("header", True).option("escape", '"').option("maxRecordsPerFile", CSV_PART_ROWS)
    writer.csv(path, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def to_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    _writer(df, mode).parquet(path)


def to_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    _writer(df, mode).json(path, ignoreNullFields=False)


def to_sql(
    df: DataFrame,
    url: str,
    table: str,
    mode: str = "overwrite",
    properties: dict[str, str] | None = None,
) -> None:
    _writer(df, mode).jdbc(url, table, properties=properties or {})
