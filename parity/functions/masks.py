"""Row predicates with pandas' two-valued logic.

A comparison with a missing value is False in pandas and null in SQL. Under AND and OR the two
agree for a filter, which drops both, so those keep the bare SQL condition and the scan can push it
down. Only negation tells them apart, so only there is the condition forced to True or False.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parity.functions.types import has_floats, normalize


@dataclass(frozen=True)
class Mask:
    """A predicate in the form a filter wants and in the form negation wants."""

    condition: Column
    two_valued: Column
    #: Whether the bare condition keeps every row to keep even where a float is NaN, so that it may filter first.
    pushable: bool = True

    def __and__(self, other: Mask) -> Mask:
        return and_(self, other)

    def __or__(self, other: Mask) -> Mask:
        return or_(self, other)

    def __invert__(self) -> Mask:
        return not_(self)


def mask(condition: Column) -> Mask:
    """A leaf comparison: missing operands make it False."""
    return Mask(condition, F.coalesce(condition, F.lit(False)))


def ne(column: Column, value: Any) -> Mask:
    """``!=`` as pandas has it: a missing operand makes it True."""
    if isinstance(value, Column):
        kept = F.coalesce(column != value, F.lit(True))
        return Mask(kept, kept, False)
    kept = column.isNull() | (column != value)
    return Mask(kept, kept)


def and_(*masks: Mask) -> Mask:
    return Mask(
        reduce(lambda a, b: a & b, (m.condition for m in masks)),
        reduce(lambda a, b: a & b, (m.two_valued for m in masks)),
        all(m.pushable for m in masks),
    )


def or_(*masks: Mask) -> Mask:
    return Mask(
        reduce(lambda a, b: a | b, (m.condition for m in masks)),
        reduce(lambda a, b: a | b, (m.two_valued for m in masks)),
        all(m.pushable for m in masks),
    )


def not_(m: Mask) -> Mask:
    return Mask(~m.two_valued, ~m.two_valued, False)


def filter_rows(df: DataFrame, predicate: Mask | Column) -> DataFrame:
    """``df[mask]``. NaN is a missing value and comes out as one; where no negation forbids it the bare condition
    filters first, for the scan to push down."""
    if not isinstance(predicate, Mask):
        return normalize(df).filter(predicate)
    if not has_floats(df):
        return df.filter(predicate.condition)
    first = df.filter(predicate.condition) if predicate.pushable else df
    return normalize(first).filter(predicate.condition)


def query(df: DataFrame, text: str) -> DataFrame:
    """``df.query(text)`` for a predicate in Spark SQL; write ``<=>`` for ``!=`` on nullable columns."""
    return normalize(df).filter(F.expr(text))
