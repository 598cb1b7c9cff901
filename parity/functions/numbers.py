"""Numeric expressions whose rounding and printing follow Python and NumPy.

The longer ones are written as SQL text: an expression is then one parsed string instead of a hundred
calls into the JVM. Arguments called ``sql`` are SQL text too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Two values closer to zero than this are compared on this scale.
MIN_SCALE = 1e-12


def round_half_even(column: Column, digits: int = 0) -> Column:
    """``Series.round``: ties go to the even neighbour."""
    scale = F.lit(float(10**digits))
    return F.rint(column * scale) / scale


def within_tolerance(left: str, right: str, tolerance: float) -> str:
    """Relative closeness, never null: both missing is close, one missing is not, equals are."""
    return f"""CASE WHEN {left} IS NULL OR {right} IS NULL THEN {left} IS NULL AND {right} IS NULL
        WHEN {left} = {right} THEN true
        ELSE abs({left} - {right}) / greatest(abs({left}), abs({right}), {MIN_SCALE!r}D) <= {float(tolerance)!r}D END"""


#: The largest double below which a whole number is a BIGINT, and below which two BIGINT factors make a decimal.
_AS_LONG, _AS_DECIMAL = "9.2e18D", "pow(2.0D, 115)"


def with_fixed_entries(df: DataFrame, entries: str, output: str) -> DataFrame:
    """Add ``output``: for each struct (x, d, form) of the array ``entries`` (SQL text) its fields and ``fixed``, the
    non-negative ``x`` as Python prints it with ``.{d}f``.

    The whole part is split off first, which is exact. The fraction times ``10**d`` is already rounded when it is
    computed, so a value just under a tie can land on it. The nearest integer is therefore decided on the exact binary
    value: split into a 24-bit head and the rest, both products are exact. Whole numbers beyond a BIGINT are a mantissa
    times a power of two, multiplied as decimals; beyond those the digits after the first 17 are zeros. The steps are
    projections of their own, each value computed once, and none of them can fail.
    """
    long, decimal = _AS_LONG, _AS_DECIMAL
    steps = (
        {"w": f"if(e.x < {long}, floor(least(e.x, {long})), 0L)", "unit": "pow(10.0D, e.d)"},
        {"f": f"if(e.x < {long}, e.x - e.w, 0.0D)"},
        {"head": "CAST(CAST(e.f AS FLOAT) AS DOUBLE)", "base": "floor(e.f * e.unit)"},
        {"excess": "(e.head * e.unit - (e.base + 0.5D)) + (e.f - e.head) * e.unit"},
        {"part": "e.base + if(e.excess > 0 OR (e.excess = 0 AND (e.base + if(e.d = 0, e.w, 0L)) % 2 <> 0), 1L, 0L)"},
        {"carry": "e.part >= e.unit", "power": f"if(e.x >= {long}, CAST(floor(log2(e.x)) AS INT) - 52, 0)"},
        {
            "whole": f"CASE WHEN e.x < {long} THEN CAST(e.w + if(e.carry, 1L, 0L) AS STRING) WHEN e.x < {decimal}"
            " THEN CAST(CAST(CAST(e.x / pow(2.0D, e.power) AS BIGINT) AS DECIMAL(19, 0))"
            " * CAST(shiftleft(1L, e.power) AS DECIMAL(19, 0)) AS STRING) ELSE format_string('%.0f', e.x) END"
        },
        {
            "fixed": "if(e.x IS NULL, NULL, concat(e.whole, if(e.d > 0, concat('.', lpad(CAST(if(e.carry, 0L, e.part)"
            " AS STRING), e.d, '0')), '')))"
        },
    )
    df = df.selectExpr("*", f"{entries} AS {output}")
    fields = ["x", "d", "form"]
    for step in steps:
        kept = [f"e.{f} AS {f}" for f in fields] + [f"{sql} AS {name}" for name, sql in step.items()]
        df = df.withColumn(output, F.expr(f"transform({output}, e -> struct({', '.join(kept)}))"))
        fields += list(step)
    return df


def with_fixed(df: DataFrame, x: str, digits: str, output: str) -> DataFrame:
    """Add non-negative ``x`` as Python prints it with ``.{digits}f``; ``x`` and ``digits`` are SQL text."""
    entry = f"array(struct(CAST({x} AS DOUBLE) AS x, CAST({digits} AS INT) AS d, '' AS form))"
    return with_fixed_entries(df, entry, "__fixed_entries").selectExpr("*", f"__fixed_entries[0].fixed AS {output}").drop(
        "__fixed_entries"
    )


#: Digits after the point that leave six significant ones, as ``:g`` does.
SIX_SIGNIFICANT = "5 - CAST(floor(log10({x})) AS INT)"


def trimmed(fixed: str, x: str) -> str:
    """SQL text of ``:g``: the six-digit text without trailing zeros, or scientific beyond its range."""
    scientific = rf"regexp_replace(format_string('%.5e', {x}), r'\.?0*e', 'e')"
    plain = rf"regexp_replace({fixed}, r'\.0*$|(\.\d*?)0+$', '$1')"
    return f"CASE WHEN {x} = 0 THEN '0' WHEN {x} >= 1e-4D AND {x} < 999999.5D THEN {plain} ELSE {scientific} END"


def with_ratio_texts(df: DataFrame, ratios: str, output: str) -> DataFrame:
    """Add ``output``: every way to quote each non-negative ratio of an array (SQL text): with two digits, with one,
    and shortest."""
    forms = {"two": "2", "one": "1", "short": SIX_SIGNIFICANT.format(x="r")}
    each = ", ".join(
        f"struct(r AS x, greatest(coalesce({n}, 0), 0) AS d, '{form}' AS form)" for form, n in forms.items()
    )
    return with_printed(df, f"flatten(transform(filter({ratios}, r -> r IS NOT NULL), r -> array({each})))", output)


def with_printed(df: DataFrame, entries: str, output: str) -> DataFrame:
    """Add ``output``: the texts of an array (SQL text) of (x, d, form); the form ``short`` is ``:g``."""
    printed = with_fixed_entries(df, entries, output)
    text = f"if(e.form = 'short', {trimmed('e.fixed', 'e.x')}, e.fixed)"
    return printed.withColumn(output, F.expr(f"transform({output}, e -> {text})"))
