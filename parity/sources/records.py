"""Run records: nested JSON documents, one per run, and the fact tables inside them."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BENCH = "STRUCT<durations: ARRAY<DOUBLE>, failed: BOOLEAN>"
_EXECUTION = "STRUCT<engine: STRING, succeeded: BOOLEAN, duration_seconds: DOUBLE>"
_DIFFERENCE = (
    "STRUCT<check: STRING, `column`: STRING, category: STRING, reference: STRING, "
    "candidate: STRING, detail: STRING>"
)

#: The parts of a run record that the fact tables need.
RECORD_DDL = f"""
migration_id STRING, source_path STRING, created_at TIMESTAMP, stage STRING,
failed BOOLEAN, failure_reason STRING,
spec STRUCT<risks: ARRAY<STRUCT<category: STRING, severity: STRING>>>,
plan STRUCT<overall_risk: STRING, requires_human_approval: BOOLEAN,
  steps: ARRAY<STRUCT<id: STRING, kind: STRING,
    semantic_differences: ARRAY<STRUCT<category: STRING, validation_check: STRING>>>>,
  validation_plan: STRUCT<join_keys: ARRAY<STRING>, numeric_tolerance: DOUBLE,
    required_checks: ARRAY<STRING>>>,
codegen STRUCT<gate_iterations: INT, code: STRUCT<filename: STRING, content: STRING>,
  static_analysis: STRUCT<passed: BOOLEAN,
    findings: ARRAY<STRUCT<code: STRING, severity: STRING, message: STRING, line: INT>>>>,
validation STRUCT<report: STRUCT<status: STRING, error: STRING,
    reference: STRUCT<row_count: BIGINT>, candidate: STRUCT<row_count: BIGINT>,
    checks: ARRAY<STRUCT<name: STRING, passed: BOOLEAN, skipped: BOOLEAN, detail: STRING,
      differences: ARRAY<{_DIFFERENCE}>>>>,
  legacy_execution: {_EXECUTION}, spark_execution: {_EXECUTION},
  test_run: STRUCT<passed: INT, failed: INT, errors: INT, skipped: INT>>,
repair STRUCT<succeeded: BOOLEAN, exhausted: BOOLEAN,
  attempts: ARRAY<STRUCT<attempt: INT, strategy: STRUCT<category: STRING, approach: STRING>,
    code_sha256: STRING, admitted: BOOLEAN, rejection_reason: STRING, validation_status: STRING,
    differences: INT>>>,
optimization STRUCT<applied: BOOLEAN,
  attempts: ARRAY<STRUCT<attempt: INT, strategy: STRUCT<approach: STRING, expected_speedup: DOUBLE>,
    admitted: BOOLEAN, rejection_reason: STRING, validation_status: STRING, accepted: BOOLEAN,
    comparison: STRUCT<min_speedup: DOUBLE, max_noise_ratio: DOUBLE, baseline: {_BENCH},
      candidate: {_BENCH}>>>,
  baseline: {_BENCH}, final: {_BENCH}>,
delivery STRUCT<decision: STRUCT<disposition: STRING>,
  audit: STRUCT<checked: INT, violations: ARRAY<STRUCT<kind: STRING, claimed: STRING>>>>,
stages ARRAY<STRUCT<stage: STRING, started_at: TIMESTAMP, ended_at: TIMESTAMP, succeeded: BOOLEAN,
  attempt: INT>>
"""


@cache
def record_schema() -> T.StructType:
    """The schema above; parsing it needs a running session."""
    return T.StructType.fromDDL(RECORD_DDL)


RECORD_FILENAME = "migration_record.json"


def scan_records(
    spark: SparkSession,
    workspace: str,
    limit: int | None = None,
    pattern: str = f"*/{RECORD_FILENAME}",
    lines: bool = False,
) -> DataFrame:
    """The newest record files below a workspace, as columns of :func:`record_schema` plus ``path``,
    ``modified_at`` and ``readable``. A file is one document or, with ``lines``, one per line.

    The newest files are chosen from the file listing alone, before any content is read; at most
    ``limit`` paths come to the driver. Without a limit all records are read. Documents that do not parse, or lack an id, a source path
    or a creation time, are kept with ``readable`` false so that they can be counted.
    """
    paths: str | list[str] = f"{workspace.rstrip('/')}/{pattern}"
    if limit is not None:
        listing = spark.read.format("binaryFile").load(paths).select("path", "modificationTime")
        newest = listing.orderBy(F.desc("modificationTime"), "path").limit(limit).collect()
        if not newest:
            return spark.createDataFrame([], _scanned_schema())
        paths = [row["path"] for row in newest]
    text = spark.read.text(paths, wholetext=not lines).select(
        F.from_json("value", record_schema(), {"mode": "PERMISSIVE"}).alias("record"),
        F.try_parse_json("value").isNotNull().alias("whole"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_modification_time").alias("modified_at"),
    )
    readable = F.col("whole")
    for name in ("migration_id", "source_path", "created_at"):
        readable = readable & F.col(f"record.{name}").isNotNull()
    return text.select("record.*", "path", "modified_at", readable.alias("readable"))


def _scanned_schema() -> T.StructType:
    return T.StructType(
        [
            *record_schema().fields,
            T.StructField("path", T.StringType()),
            T.StructField("modified_at", T.TimestampType()),
            T.StructField("readable", T.BooleanType()),
        ]
    )


def stream_records(spark: SparkSession, directory: str, files_per_trigger: int = 1000) -> DataFrame:
    """Records as they arrive as JSON files, one document per line."""
    return spark.readStream.schema(record_schema()).option("maxFilesPerTrigger", files_per_trigger).json(directory)


# --- derived facts of one record ------------------------------------------------------------------


def report_status(checks: Column, error: Column) -> Column:
    """Status recomputed from the checks; a stored one is never trusted."""
    return (
        F.when(error.isNotNull() | checks.isNull() | (F.size(checks) == 0), "ERROR")
        .when(F.exists(checks, lambda c: F.coalesce(c["skipped"], F.lit(False))), "ERROR")
        .when(F.forall(checks, lambda c: c["passed"]), "PASS")
        .otherwise("FAIL")
    )


def validation_status() -> Column:
    """PASS, FAIL or ERROR; null for a record that was never validated."""
    report = F.col("validation.report")
    return F.when(F.col("validation").isNotNull(), report_status(report["checks"], report["error"]))


def risk() -> Column:
    """The planned risk, low when there is no plan."""
    return F.coalesce(F.col("plan.overall_risk"), F.lit("low"))


def semantic_differences() -> Column:
    """All declared differences of the plan's steps, one array."""
    return F.flatten(F.transform(F.col("plan.steps"), lambda s: s["semantic_differences"]))


def duration_of(stage: Column) -> Column:
    """Seconds of a stage, null while it is open."""
    micros = F.unix_micros(stage["ended_at"]) - F.unix_micros(stage["started_at"])
    return micros / F.lit(1_000_000.0)


def total_duration() -> Column:
    return F.aggregate(
        F.coalesce("stages", F.array().cast(record_schema()["stages"].dataType)),
        F.lit(0.0),
        lambda total, s: total + F.coalesce(duration_of(s), F.lit(0.0)),
    )


# --- fact tables ------------------------------------------------------------------------------------


def explode_stages(records: DataFrame) -> DataFrame:
    """``migration_id, stage, attempt, succeeded, started_at, ended_at, seconds``."""
    rows = records.select("migration_id", F.explode("stages").alias("s"))
    return rows.select(
        "migration_id", "s.stage", "s.attempt", "s.succeeded", "s.started_at", "s.ended_at",
        duration_of(F.col("s")).alias("seconds"),
    )


def explode_checks(records: DataFrame) -> DataFrame:
    """``migration_id, ordinal, name, passed, skipped, detail, differences``."""
    rows = records.select("migration_id", F.posexplode("validation.report.checks").alias("ordinal", "c"))
    return rows.select(
        "migration_id", "ordinal", "c.name", "c.passed",
        F.coalesce("c.skipped", F.lit(False)).alias("skipped"), "c.detail", "c.differences",
    )


def explode_differences(records: DataFrame) -> DataFrame:
    """``migration_id, check, column, category, reference, candidate, detail`` of every check."""
    checks = explode_checks(records)
    return checks.select("migration_id", "ordinal", F.posexplode("differences").alias("place", "d")).select(
        "migration_id", "ordinal", "place", "d.*"
    )


def explode_repairs(records: DataFrame) -> DataFrame:
    """``migration_id, attempt, category, approach, code_sha256, admitted, succeeded, differences``."""
    rows = records.select("migration_id", F.explode("repair.attempts").alias("a"))
    return rows.select(
        "migration_id", "a.attempt", "a.strategy.category", "a.strategy.approach", "a.code_sha256",
        F.coalesce("a.admitted", F.lit(True)).alias("admitted"), "a.rejection_reason", "a.validation_status",
        F.coalesce(F.col("a.validation_status") == "PASS", F.lit(False)).alias("succeeded"),
        "a.differences",
    )


def explode_optimizations(records: DataFrame) -> DataFrame:
    """One row per optimisation attempt, the measured comparison kept as a struct."""
    rows = records.select("migration_id", F.explode("optimization.attempts").alias("a"))
    return rows.select(
        "migration_id", "a.attempt", "a.strategy.approach", "a.strategy.expected_speedup",
        F.coalesce("a.admitted", F.lit(True)).alias("admitted"), "a.rejection_reason",
        "a.validation_status", F.coalesce("a.accepted", F.lit(False)).alias("accepted"), "a.comparison",
    )
