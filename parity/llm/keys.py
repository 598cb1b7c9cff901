"""Row keys for documents whose ids may be null or repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_key(text: str = "text") -> Column:
    """Together with the id this names a row: rows that agree in both get equal results anyway."""
    return F.xxhash64(F.col(text))


def same_row(left: DataFrame, right: DataFrame, id_col: str, key: str) -> Column:
    return left[id_col].eqNullSafe(right[id_col]) & (left[key] == right[key])


def spare(columns: list[str], name: str) -> str:
    """``name``, with underscores added until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name
