"""Helpers to hold a Spark result against a pandas one, whatever the row order."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def to_spark(spark: SparkSession, pdf: pd.DataFrame, schema: str) -> DataFrame:
    rows = [tuple(None if _missing(v) else v for v in row) for row in pdf.itertuples(index=False)]
    names = [part.split()[0] for part in schema.split(",")]
    types = [part.split()[1] for part in schema.split(",")]
    casts = {"bigint": int, "int": int, "double": float, "string": str, "boolean": bool}
    rows = [
        tuple(v if v is None else casts.get(t, lambda x: x)(v) for v, t in zip(row, types, strict=True))
        for row in rows
    ]
    assert names == list(pdf.columns)
    return spark.createDataFrame(rows, schema)


def _missing(v) -> bool:
    return v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)) or v is pd.NA


def _plain(v):
    if _missing(v):
        return "~"
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.9g}"
    return str(v)


def rows_of_pandas(pdf: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(_plain(v) for v in row) for row in pdf.astype(object).itertuples(index=False))


def rows_of_spark(df: DataFrame) -> list[tuple]:
    return sorted(tuple(_plain(v) for v in row) for row in df.collect())


def assert_same(df: DataFrame, pdf: pd.DataFrame) -> None:
    assert df.columns == [str(c) for c in pdf.columns]
    assert rows_of_spark(df) == rows_of_pandas(pdf)
