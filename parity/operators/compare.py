"""Equivalence of two datasets: named checks, located differences and a computed verdict.

Both sides always go through the same code. Row order is never compared. A check that cannot run is
skipped, and a skipped check is never a pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parity.functions.numbers import within_tolerance
from parity.functions.types import (
    double_sql,
    dtype_family,
    is_numeric,
    literal_sql,
    normalize,
    quoted,
    text_sql,
)
from parity.operators.align import BLOCK, aligned
from parity.operators.skew import BROADCAST_LIMIT_ROWS, broadcastable
from parity.operators.stats import (
    column_stats,
    duplicate_count,
    has_duplicates,
    literal_rows,
    measures,
)
from parity.session import pinned
from parity.sources.datasets import DatasetError, load_dataset

# The named checks, and those run when nothing else is asked for.
KNOWN_CHECKS = (
    "schema",
    "row_count",
    "null_counts",
    "duplicate_counts",
    "aggregate_checksums",
    "column_statistics",
    "numeric_tolerance",
)
DEFAULT_CHECKS = (
    "schema",
    "row_count",
    "null_counts",
    "numeric_tolerance",
    "duplicate_counts",
    "aggregate_checksums",
)
DEFAULT_TOLERANCE = 1e-9
MAX_SAMPLES = 10

DIFFERENCE = "check string, column string, category string, reference string, candidate string, detail string"


# How rows are paired where keys do not name them.
NOT_UNIQUE, NO_KEYS = "sorted rows (keys not unique)", "sorted rows (no usable keys)"


@dataclass(frozen=True)
class Comparison:
    """Lazily computed results of one comparison.

    ``differences`` has samples of differing records, ``all_differences`` every one of them. ``statistics`` has the
    columns of both sides, with ``side``.
    """

    checks: DataFrame
    differences: DataFrame
    verdict: DataFrame
    all_differences: DataFrame | None = None
    statistics: DataFrame | None = None
    cached: tuple[DataFrame, ...] = ()

    def close(self) -> None:
        """Give back what ``cache`` holds."""
        for side in self.cached:
            side.unpersist()


def _shared(ref: DataFrame, cand: DataFrame) -> list[str]:
    return [c for c in ref.columns if c in cand.columns]


def _usable(ref: DataFrame, cand: DataFrame, keys: Sequence[str]) -> list[str]:
    return [k for k in keys if k in ref.columns and k in cand.columns]


def _rows(
    df: DataFrame, check: str, column: Column, category: Column, ref: Column, cand: Column, detail: Column
) -> DataFrame:
    named = zip(
        ("check", "column", "category", "reference", "candidate", "detail"),
        (F.lit(check), column, category, ref, cand, detail),
        strict=True,
    )
    return df.select(*[value.cast("string").alias(name) for name, value in named])


# --- schema -----------------------------------------------------------------------------------


def schema_differences(ref: DataFrame, cand: DataFrame) -> DataFrame:
    """Missing and extra columns, changed type families; column order only when nothing else differs."""
    left = {f.name: f.dataType for f in ref.schema.fields}
    right = {f.name: f.dataType for f in cand.schema.fields}
    rows: list[tuple] = []
    for name in left:
        if name not in right:
            rows.append(("schema", name, None, "present", "absent", "column is missing from the candidate"))
    for name in right:
        if name not in left:
            rows.append(
                ("schema", name, "index_semantics", "absent", "present", "column is not in the reference")
            )
    for name in left:
        if name in right and dtype_family(left[name]) != dtype_family(right[name]):
            a, b = (f"{t.simpleString()} ({dtype_family(t)})" for t in (left[name], right[name]))
            rows.append(("schema", name, "type_coercion", a, b, "type family differs"))
    if not rows and list(left) != list(right):
        rows.append(("schema", None, None, str(list(left)), str(list(right)), "columns in a different order"))
    return literal_rows(ref.sparkSession, DIFFERENCE, rows)


# --- checks that one pass per side can answer ----------------------------------------------------


def _side_by_side(ref: DataFrame, cand: DataFrame, columns: Sequence[str], portable: bool) -> DataFrame:
    """The measures of both sides, ``r_*`` and ``c_*``, one row per shared column."""
    left, right = (
        frame.selectExpr(*[f"{c} AS {prefix}{c}" for c in frame.columns])
        for prefix, frame in (
            ("r_", measures(ref, columns, portable)),
            ("c_", measures(cand, columns, portable)),
        )
    )
    return left.join(right, F.col("r_column") == F.col("c_column"))


def _difference(check: str, column: str, category: str, reference: str, candidate: str, detail: str) -> str:
    """SQL text of one difference; every argument but the check is SQL text."""
    named = {"check": f"'{check}'", "column": column, "category": category, "reference": reference}
    named |= {"candidate": candidate, "detail": detail}
    return "struct(" + ", ".join(f"CAST({v} AS STRING) AS {k}" for k, v in named.items()) + ")"


#: Checks that the measures of the two sides answer between them.
ONE_PASS_CHECKS = ("row_count", "null_counts", "aggregate_checksums", "column_statistics")


def measured_differences(both: DataFrame, checks: Sequence[str], tolerance: float) -> DataFrame:
    """Differences of all the checks that need one aggregation per side, from one reading of it.

    Row counts are equal or not; null counts per column; totals of numeric columns by tolerance, of
    other columns the multiset of values and the null count; min, max and mean by tolerance.
    """
    numeric = "(r_is_numeric AND c_is_numeric)"
    found: list[tuple[str, str]] = []
    if "row_count" in checks:
        text = "format_string('row counts differ by %+d', c_row_count - r_row_count)"
        row = _difference("row_count", "NULL", "'null_semantics'", "r_row_count", "c_row_count", text)
        found.append(("r_ordinal = 0 AND r_row_count <> c_row_count", row))
    if "null_counts" in checks:
        row = _difference(
            "null_counts", "r_column", "'null_semantics'", "r_null_count", "c_null_count", "'null counts differ'"
        )
        found.append(("r_null_count <> c_null_count", row))
    if "aggregate_checksums" in checks:
        a, b = (f"coalesce({s}_total, 0.0D)" for s in "rc")
        text = "'column totals differ beyond tolerance'"
        row = _difference("aggregate_checksums", "r_column", "'floating_point'", a, b, text)
        found.append((f"{numeric} AND NOT ({within_tolerance(a, b, tolerance)})", row))
        same = "r_checksum = c_checksum AND r_null_count = c_null_count AND r_row_count = c_row_count"
        row = _difference(
            "aggregate_checksums", "r_column", "NULL", "r_checksum", "c_checksum", "'column values differ'"
        )
        found.append((f"NOT {numeric} AND NOT ({same})", row))
    if "column_statistics" in checks:
        for label, column in (("min", "low"), ("max", "high"), ("mean", "mean")):
            a, b = f"r_{column}", f"c_{column}"
            row = _difference(
                "column_statistics", "r_column", "'floating_point'", f"concat('{label}=', {a})",
                f"concat('{label}=', {b})", f"'{label} differs beyond tolerance'",
            )
            known = f"{numeric} AND r_total IS NOT NULL AND c_total IS NOT NULL"
            found.append((f"{known} AND NOT ({within_tolerance(a, b, tolerance)})", row))
    rows = ", ".join(f"if({condition}, {row}, NULL)" for condition, row in found)
    return both.selectExpr(f"inline(array_compact(array({rows})))")


def distinct_differences(ref: DataFrame, cand: DataFrame, columns: Sequence[str]) -> DataFrame | None:
    """Distinct counts of the columns that are not numeric on both sides."""
    others = [
        c for c in columns if not (is_numeric(ref.schema[c].dataType) and is_numeric(cand.schema[c].dataType))
    ]
    if not others:
        return None
    names = ", ".join(literal_sql(c) for c in others)

    def cells(df: DataFrame, flags: Sequence[str]) -> DataFrame:
        values = (f"struct({i} AS ordinal, {text_sql(quoted(c), df.schema[c].dataType)} AS value)" for i, c in enumerate(others))
        return df.selectExpr(f"inline(array({', '.join(values)}))").filter("value IS NOT NULL").selectExpr("*", *flags)

    # a value of both sides is one row of the shuffle
    met = cells(ref, ("1 AS a", "0 AS b")).unionByName(cells(cand, ("0 AS a", "1 AS b")))
    values = met.groupBy("ordinal", "value").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    sums = values.groupBy("ordinal").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    counts = sums.selectExpr(f"array({names})[ordinal] AS column", "a", "b")
    return _rows(
        counts.filter("a != b"), "column_statistics", F.col("column"), F.lit(None), F.col("a"), F.col("b"),
        F.concat_ws(" ", F.lit("distinct values:"), F.col("a"), F.lit("against"), F.col("b")),
    )


@dataclass(frozen=True)
class KeyFacts:
    """What the keys of both sides say: repeats on the keys, and the keys whose records need a look.

    A key outside ``suspects`` is there once on each side, with records that agree.
    """

    repeats: tuple[int, int]
    suspects: DataFrame
    count: int

    @property
    def unique(self) -> bool:
        return self.repeats == (0, 0)


def key_facts(
    ref: DataFrame, cand: DataFrame, keys: Sequence[str], tolerance: float = DEFAULT_TOLERANCE
) -> KeyFacts | None:
    """One grouping of both sides by key, in which records that agree cancel out.

    The fingerprints of a key's records (128 bits, missing values marked) are combined by exclusive or, so a key
    with one record a side has zero if the records are equal. Fractional columns are not part of the fingerprint:
    with one record a side their least and greatest value are the two to hold against each other, and the tolerance
    is the same in either direction. All of it combines before the shuffle. None where the types of the sides differ
    or a value is nested.
    """
    columns = _shared(ref, cand)
    types = [ref.schema[c].dataType for c in columns]
    nested = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
    if types != [cand.schema[c].dataType for c in columns] or any(isinstance(t, nested) for t in types):
        return None
    values = [c for c in columns if c not in keys]
    fractions = [c for c in values if isinstance(ref.schema[c].dataType, (T.DoubleType, T.FloatType, T.DecimalType))]
    # the hash passes over missing values, so where they are is hashed too
    marked = ["0", *[quoted(c) for c in values if c not in fractions], *[f"{quoted(c)} IS NULL" for c in values]]

    def side(df: DataFrame, n: int) -> DataFrame:
        hashes = [f"xxhash64({seed}, {', '.join(marked)}) AS __h{seed}" for seed in (1, 2)]
        named = [f"{quoted(k)} AS __k{i}" for i, k in enumerate(keys)]
        near = [f"{double_sql(quoted(c), ref.schema[c].dataType)} AS __v{i}" for i, c in enumerate(fractions)]
        return df.selectExpr(*named, f"{1 - n} AS __r", f"{n} AS __c", *hashes, *near)

    names = [f"__k{i}" for i in range(len(keys))]
    met = side(ref, 0).unionByName(side(cand, 1)).groupBy(*names)
    counted = met.agg(
        *[F.sum(x).alias(x) for x in ("__r", "__c")], *[F.bit_xor(x).alias(x) for x in ("__h1", "__h2")],
        *[f(f"__v{i}").alias(f"__{n}{i}") for i in range(len(fractions)) for n, f in (("low", F.min), ("high", F.max))],
    )
    apart = [f"NOT ({within_tolerance(f'__low{i}', f'__high{i}', tolerance)})" for i in range(len(fractions))]
    asked = " OR ".join(["__r <> 1", "__c <> 1", "__h1 <> 0", "__h2 <> 0", *apart])
    suspects = pinned(counted.filter(asked).select(*names, "__r", "__c"))
    row = suspects.agg(
        F.count(F.lit(1)), *[F.coalesce(F.sum(F.greatest(F.col(x) - 1, F.lit(0))), F.lit(0)) for x in ("__r", "__c")]
    ).first()
    return KeyFacts((row[1], row[2]), suspects, row[0])


def _suspected(ref: DataFrame, cand: DataFrame, keys: Sequence[str], facts: KeyFacts) -> list[DataFrame]:
    """The records of the keys that need a look. Too many keys for a broadcast: all records, since picking some would
    shuffle them all by key, as their join does."""
    marks = facts.suspects.drop("__r", "__c")
    if facts.count > BROADCAST_LIMIT_ROWS or not broadcastable(marks):
        return [ref, cand]
    on = " AND ".join(f"{quoted(k)} <=> __k{i}" for i, k in enumerate(keys))
    return [df.join(F.broadcast(marks), F.expr(on), "left_semi") for df in (ref, cand)]


def duplicate_differences(
    ref: DataFrame, cand: DataFrame, keys: Sequence[str], facts: KeyFacts | None = None
) -> DataFrame | None:
    """Repeated rows, and repeats on the keys, counted on both sides. None: nothing repeats, by what is known already."""
    if facts is not None and facts.unique:
        return None

    def compared(columns_of, column: str | None, detail: str) -> DataFrame:
        a = duplicate_count(ref, columns_of(ref), "a").select("a")
        b = duplicate_count(cand, columns_of(cand), "b").select("b")
        pair = a.unionByName(b, allowMissingColumns=True).agg(F.max("a").alias("a"), F.max("b").alias("b"))
        return _rows(
            pair.filter("a != b"), "duplicate_counts", F.lit(column), F.lit("duplicate_explosion"),
            F.col("a"), F.col("b"), F.lit(detail),
        )

    found = compared(lambda df: df.columns, None, "duplicate row counts differ")
    usable = _usable(ref, cand, keys)
    if usable:
        by_key = compared(lambda _: usable, ",".join(usable), "duplicate counts on the keys differ")
        found = found.unionByName(by_key)
    return found


# --- record by record ----------------------------------------------------------------------------


def _mismatch(left: str, right: str, lt: T.DataType, rt: T.DataType, tolerance: float) -> str:
    if is_numeric(lt) and is_numeric(rt):
        return f"NOT ({within_tolerance(double_sql(left, lt), double_sql(right, rt), tolerance)})"
    if dtype_family(lt) != dtype_family(rt):
        return f"NOT ({left} IS NULL AND {right} IS NULL)"
    if isinstance(lt, T.MapType):
        left, right = text_sql(left, lt), text_sql(right, rt)
    return f"NOT ({left} <=> {right})"


def _mismatched_cells(
    ref: DataFrame, cand: DataFrame, columns: Sequence[str], left: str, right: str, tolerance: float
) -> str:
    """Array of the cells that differ, so that only those become rows. ``left`` and ``right`` name the
    structs that hold the two sides' values."""
    cells = []
    for i, c in enumerate(columns):
        lt, rt = ref.schema[c].dataType, cand.schema[c].dataType
        a, b = f"{left}.{quoted(c)}", f"{right}.{quoted(c)}"
        cell = (
            f"struct({i} AS ordinal, {literal_sql(c)} AS column, {text_sql(a, lt)} AS reference, "
            f"{text_sql(b, rt)} AS candidate)"
        )
        cells.append(f"if({_mismatch(a, b, lt, rt, tolerance)}, {cell}, NULL)")
    return f"array_compact(array({', '.join(cells)}))"


def keyed_cells(
    ref: DataFrame, cand: DataFrame, keys: Sequence[str], tolerance: float = DEFAULT_TOLERANCE
) -> DataFrame:
    """Every record difference between two frames with unique keys.

    ``kind, key, ordinal, column, reference, candidate``; kind is left_only, right_only or cell.
    One null-safe full join; only differing cells are turned into rows.
    """
    columns = [c for c in _shared(ref, cand) if c not in keys]

    def side(df: DataFrame, name: str) -> DataFrame:
        values = ", ".join(quoted(c) for c in (*keys, *columns))
        return df.selectExpr(*[f"{quoted(k)} AS __{name}{i}" for i, k in enumerate(keys)], f"struct({values}) AS {name}")

    left, right = side(ref, "r"), side(cand, "c")
    on = " AND ".join(f"__r{i} <=> __c{i}" for i in range(len(keys)))
    joined = left.join(right, F.expr(on), "full")
    parts = []
    for i, k in enumerate(keys):
        value = f"if(r IS NULL, __c{i}, __r{i})"
        text = f"coalesce({text_sql(value, ref.schema[k].dataType)}, 'None')"
        parts.append(f"concat({literal_sql(k + '=')}, {text})")
    keyed = joined.selectExpr("r", "c", f"concat_ws(', ', {', '.join(parts)}) AS key")

    def whole_row(reference: str, candidate: str) -> str:
        return (
            f"array(struct(-1 AS ordinal, CAST(NULL AS STRING) AS column, {reference} AS reference, "
            f"{candidate} AS candidate))"
        )

    only_left, only_right = whole_row("key", "'absent'"), whole_row("'absent'", "key")
    cells = (
        _mismatched_cells(ref, cand, columns, "r", "c", tolerance)
        if columns
        else f"filter({only_left}, x -> false)"
    )
    return keyed.selectExpr(
        "CASE WHEN c IS NULL THEN 'left_only' WHEN r IS NULL THEN 'right_only' ELSE 'cell' END AS kind",
        "key",
        f"inline(CASE WHEN c IS NULL THEN {only_left} WHEN r IS NULL THEN {only_right} ELSE {cells} END)",
    )


def keyed_summary(cells: DataFrame) -> DataFrame:
    """``kind, column, mismatches``."""
    return cells.groupBy("kind", "column").agg(F.count(F.lit(1)).alias("mismatches"))


def sorted_cells(
    ref: DataFrame, cand: DataFrame, tolerance: float = DEFAULT_TOLERANCE, block: int = BLOCK
) -> DataFrame:
    """Every cell that differs when both frames are sorted on all shared columns.

    ``pos, n, ordinal, column, reference, candidate``: the cell differs at n positions from pos on.
    """
    columns = _shared(ref, cand)
    left, right = ref.select(*columns), cand.select(*columns)
    cells = _mismatched_cells(left, right, columns, "r", "c", tolerance)
    return aligned(left, right, columns, block).selectExpr("pos", "n", f"inline({cells})")


def samples(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], n: int = MAX_SAMPLES) -> DataFrame:
    """The first n rows of each group; Spark limits each task's groups before the shuffle."""
    number = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("__rn", number).filter(F.col("__rn") <= n).drop("__rn")


def keyed_differences(cells: DataFrame, n: int = MAX_SAMPLES) -> DataFrame:
    """At most n rows per side and per column, at most 2n in all, with the count per column."""
    picked = samples(cells, ["kind", "column"], ["key"], n)
    counted = picked.join(
        keyed_summary(cells).withColumnsRenamed({"kind": "__kind", "column": "__column"}),
        F.col("kind").eqNullSafe(F.col("__kind")) & F.col("column").eqNullSafe(F.col("__column")),
    )
    side = F.when(F.col("kind") == "left_only", 0).when(F.col("kind") == "right_only", 1).otherwise(2)
    capped = counted.orderBy(side, "ordinal", "key").limit(2 * n)
    detail = (
        F.when(F.col("kind") == "left_only", F.format_string("one of %d reference records without a partner", "mismatches"))
        .when(F.col("kind") == "right_only", F.format_string("one of %d candidate records without a partner", "mismatches"))
        .otherwise(F.format_string("key %s, the column differs in %d rows", "key", "mismatches"))
    )
    return _cell_rows(capped, detail)


def _cell_rows(cells: DataFrame, detail: Column) -> DataFrame:
    category = F.when(F.col("kind") == "cell", "floating_point")
    return _rows(
        cells, "numeric_tolerance", F.col("column"), category, F.col("reference"), F.col("candidate"), detail
    )


def all_keyed_differences(cells: DataFrame) -> DataFrame:
    """Every differing cell and every record of one side only."""
    side = F.when(F.col("kind") == "left_only", "reference only").when(F.col("kind") == "right_only", "candidate only")
    return _cell_rows(cells, F.concat_ws(" ", F.concat(F.lit("key "), F.col("key")), side))


def sorted_differences(cells: DataFrame, strategy: str, n: int | None = MAX_SAMPLES) -> DataFrame:
    """The first n positions per column, or all of them."""
    few = cells if n is None else samples(cells, ["column"], ["pos"], n)
    last = F.col("n") if n is None else F.least(F.col("n"), F.lit(n))
    spread = few.withColumn("pos", F.explode(F.sequence(F.col("pos"), F.col("pos") + last - 1)))
    detail = F.format_string(f"{strategy}, position %d of both sorted sides", "pos")
    return _rows(
        spread if n is None else samples(spread, ["column"], ["pos"], n),
        "numeric_tolerance", F.col("column"), F.lit(None), F.col("reference"), F.col("candidate"), detail,
    )


def record_check(
    ref: DataFrame,
    cand: DataFrame,
    keys: Sequence[str],
    tolerance: float = DEFAULT_TOLERANCE,
    n: int = MAX_SAMPLES,
    facts: KeyFacts | None = None,
) -> tuple[DataFrame | None, DataFrame | None, str]:
    """Sampled and all differences of the record-level check, and what was done. None: the check cannot run.

    The strategy depends on the data, so whether the keys are unique (and, without keys, whether
    the sizes agree) is looked up here, each by a job that returns one value. With ``facts`` that is known, and
    only records of keys in question are joined.
    """
    spark = ref.sparkSession
    usable = _usable(ref, cand, keys)
    if keys and not usable:
        return None, None, f"keys {list(keys)}: reference has {sorted(set(keys) & set(ref.columns))}, candidate {sorted(set(keys) & set(cand.columns))}"
    if usable and (facts.unique if facts else not (has_duplicates(ref, usable) or has_duplicates(cand, usable))):
        told = f"records keyed on {usable} at tolerance {tolerance:g}"
        if facts and not facts.count:
            found = literal_rows(spark, DIFFERENCE, [])
            return found, found, told
        left, right = _suspected(ref, cand, usable, facts) if facts else (ref, cand)
        cells = keyed_cells(left, right, usable, tolerance)
        return keyed_differences(cells, n), all_keyed_differences(cells), told
    strategy = NOT_UNIQUE if usable else NO_KEYS
    a, b = ref.count(), cand.count()
    if a != b:
        text = f"sides of {a} and {b} rows have no common positions"
        found = literal_rows(spark, DIFFERENCE, [("numeric_tolerance", None, None, str(a), str(b), text)])
        return found, found, f"{strategy}: {a} and {b} rows"
    if not _shared(ref, cand):
        found = literal_rows(spark, DIFFERENCE, [])
        return found, found, f"{strategy}: no shared columns"
    cells = sorted_cells(ref, cand, tolerance)
    told = f"{strategy}: {a} rows at tolerance {tolerance:g}"
    return sorted_differences(cells, strategy, n), sorted_differences(cells, strategy, None), told


# --- verdict -------------------------------------------------------------------------------------


def verdict(checks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``status``: ERROR without checks or with a skipped one, PASS when all passed, else FAIL."""
    status = (
        F.when(F.count(F.lit(1)) == 0, "ERROR")
        .when(F.bool_or("skipped"), "ERROR")
        .when(F.bool_and("passed"), "PASS")
        .otherwise("FAIL")
    )
    columns = [status.alias("status"), F.count(F.lit(1)).alias("checks"), F.count_if(~F.col("passed")).alias("failed")]
    return checks.groupBy(*by).agg(*columns) if by else checks.agg(*columns)


def error_verdict(spark: SparkSession, message: str) -> DataFrame:
    """Verdict of a comparison whose data could not be read."""
    return literal_rows(
        spark, "status string, checks bigint, failed bigint, error string", [("ERROR", 0, 0, message)]
    )


def summary(checks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Flat booleans of the three headline checks, and the names of all failed or skipped ones."""

    def passed(name: str) -> Column:
        ok = F.col("passed") & ~F.col("skipped")
        return F.coalesce(F.max(F.when(F.col("name") == name, ok)), F.lit(False))

    failed = F.array_sort(F.collect_set(F.when(~F.col("passed") | F.col("skipped"), F.col("name"))))
    columns = [
        passed("schema").alias("schema_match"),
        passed("row_count").alias("row_count_match"),
        passed("numeric_tolerance").alias("numeric_tolerance_passed"),
        failed.alias("failed_checks"),
    ]
    return checks.groupBy(*by).agg(*columns) if by else checks.agg(*columns)


def by_category(differences: DataFrame) -> DataFrame:
    """Number of differences and columns concerned per root-cause category."""
    return differences.groupBy("category").agg(
        F.count(F.lit(1)).alias("differences"), F.array_sort(F.collect_set("column")).alias("columns")
    )


def with_external_check(checks: DataFrame, name: str, passed: Column | bool, detail: str = "") -> DataFrame:
    """Append a check measured elsewhere; it moves the verdict like any other."""
    row = checks.sparkSession.range(0, 1, 1, 1).select(
        F.lit(name).alias("name"),
        (F.lit(passed) if isinstance(passed, bool) else passed).alias("passed"),
        F.lit(False).alias("skipped"),
        F.lit(detail).alias("detail"),
    )
    return checks.unionByName(row)


def required_checks(plans: DataFrame) -> DataFrame:
    """Checks each plan asks for: its own, then one per declared semantic difference, each once.

    ``plans`` has ``id``, ``required`` and ``declared`` (arrays of names). Out come ``id, ordinal,
    name, known``; an unknown check is one that must be reported as skipped.
    """
    wanted = F.array_distinct(F.concat("required", "declared"))
    return plans.select("id", F.posexplode(wanted).alias("ordinal", "name")).withColumn(
        "known", F.col("name").isin(*KNOWN_CHECKS)
    )


def compare(
    reference: DataFrame,
    candidate: DataFrame,
    keys: Sequence[str] = (),
    tolerance: float = DEFAULT_TOLERANCE,
    checks: Sequence[str] = DEFAULT_CHECKS,
    portable_checksum: bool = False,
    n: int = MAX_SAMPLES,
    cache: bool = False,
) -> Comparison:
    """Run the named checks on two frames.

    Row counts, null counts, checksums and column statistics come from one aggregation per side, duplicates and
    equal records from one grouping of both sides by key. Only records of keys whose fingerprints differ are read
    again. ``cache`` keeps inputs that are costly to compute, on disk where memory ends.
    """
    spark = reference.sparkSession
    ref, cand = normalize(reference), normalize(candidate)
    if cache:
        ref, cand = (side.persist(StorageLevel.MEMORY_AND_DISK) for side in (ref, cand))
    columns = _shared(ref, cand)
    parts: list[DataFrame] = []
    rows: list[tuple[str, bool, str]] = []
    sampled = complete = literal_rows(spark, DIFFERENCE, [])
    usable = _usable(ref, cand, keys)
    by_key = usable and ("numeric_tolerance" in checks or "duplicate_counts" in checks)
    facts = key_facts(ref, cand, usable, tolerance) if by_key else None
    one_pass = [c for c in dict.fromkeys(checks) if c in ONE_PASS_CHECKS]
    if one_pass and columns:
        both = _side_by_side(ref, cand, columns, portable_checksum)
        parts.append(measured_differences(both, one_pass, tolerance))
    for name in dict.fromkeys(checks):
        skipped = False
        if name not in KNOWN_CHECKS:
            skipped, text = True, f"unknown check; known checks: {', '.join(sorted(KNOWN_CHECKS))}"
        elif name == "schema":
            parts.append(schema_differences(ref, cand))
            text = f"{len(ref.columns)} reference, {len(cand.columns)} candidate columns"
        elif name == "duplicate_counts":
            repeats = duplicate_differences(ref, cand, keys, facts)
            parts += [repeats] if repeats is not None else []
            text = f"repeats of whole rows of {len(ref.columns)} columns, and of {len(list(keys))} keys"
        elif name == "numeric_tolerance":
            found, every, text = record_check(ref, cand, keys, tolerance, n, facts)
            skipped = found is None
            if found is not None:
                sampled, complete = found, every
        else:
            skipped, text = not columns, f"{len(columns)} shared columns"
            distinct = distinct_differences(ref, cand, columns) if name == "column_statistics" else None
            if distinct is not None:
                parts.append(distinct)
        rows.append((name, skipped, text))
    differences = reduce(DataFrame.unionByName, parts, sampled)
    declared = literal_rows(spark, "name string, skipped boolean, detail string", rows)
    counts = differences.groupBy("check").agg(F.count(F.lit(1)).alias("__n"))
    results = declared.join(counts, F.col("name") == F.col("check"), "left").select(
        "name",
        (F.col("__n").isNull() & ~F.col("skipped")).alias("passed"),
        "skipped",
        "detail",
    )
    statistics = reduce(
        DataFrame.unionByName,
        (column_stats(side).withColumn("side", F.lit(name)) for name, side in (("reference", ref), ("candidate", cand))),
    )
    every = reduce(DataFrame.unionByName, parts, complete)
    return Comparison(results, differences, verdict(results), every, statistics, (ref, cand) if cache else ())


def compare_paths(spark: SparkSession, reference: str, candidate: str, **options) -> Comparison:
    """:func:`compare` for outputs on disk. One that cannot be read makes the verdict ERROR, with the message."""
    sides = []
    for path in (reference, candidate):
        try:
            sides.append(load_dataset(spark, path))
        except (DatasetError, AnalysisException) as exc:
            none = literal_rows(spark, "name string, passed boolean, skipped boolean, detail string", [])
            return Comparison(none, literal_rows(spark, DIFFERENCE, []), error_verdict(spark, str(exc)))
    return compare(*sides, **options)
