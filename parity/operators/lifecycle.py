"""Stages, risk and findings of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stages a run resumes at, in order; severities from lowest to highest.
STAGE_ORDER = (
    "discovery",
    "planning",
    "approval",
    "code_generation",
    "static_analysis",
    "validation",
    "optimization",
)
APPROVAL = "approval"
SEVERITIES = ("low", "medium", "high")


def rank_of(severity: Column) -> Column:
    """0, 1, 2 for low, medium, high; null for anything else."""
    position = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity)
    return F.when(position > 0, position - 1)


def max_severity(severities: Column) -> Column:
    """The highest of an array of severities; null when empty."""
    top = F.array_max(F.transform(severities, rank_of))
    return F.get(F.array(*[F.lit(s) for s in SEVERITIES]), top.cast("int"))


def record_risk() -> Column:
    """Planned risk, else the highest risk found in the source, else low."""
    found = max_severity(F.transform(F.col("spec.risks"), lambda r: r["severity"]))
    return F.coalesce(F.col("plan.overall_risk"), found, F.lit("low"))


def risk_rollup(records: DataFrame) -> DataFrame:
    """``migration_id, risk, requires_approval``: approval is policy, whatever the plan says."""
    return records.select(
        "migration_id",
        record_risk().alias("risk"),
        F.coalesce(F.col("plan.overall_risk") == "high", F.lit(False)).alias("requires_approval"),
    )


def stage_durations(stages: DataFrame, by: Sequence[str] = ("migration_id",)) -> DataFrame:
    """``total_seconds, closed_stages``; open stages do not count."""
    return stages.groupBy(*by).agg(
        F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("total_seconds"),
        F.count("seconds").alias("closed_stages"),
    )


def resume_points(records: DataFrame) -> DataFrame:
    """``migration_id, resume_at``: the first stage without a success. Approval counts only if required."""
    done = F.transform(
        F.filter("stages", lambda s: F.coalesce(s["succeeded"], F.lit(False))), lambda s: s["stage"]
    )
    done = F.coalesce(done, F.array().cast("array<string>"))
    needed = F.coalesce("plan.requires_human_approval", F.lit(False))
    todo = F.filter(
        F.array(*[F.lit(s) for s in STAGE_ORDER]),
        lambda s: ~F.array_contains(done, s) & ((s != APPROVAL) | needed),
    )
    return records.select("migration_id", F.coalesce(F.get(todo, F.lit(0)), F.lit(STAGE_ORDER[-1])).alias("resume_at"))


def explode_findings(records: DataFrame) -> DataFrame:
    rows = records.select("migration_id", F.explode("codegen.static_analysis.findings").alias("f"))
    return rows.select("migration_id", "f.code", "f.severity", "f.message", "f.line")


def findings_pass(findings: DataFrame, by: Sequence[str] = ("migration_id",)) -> DataFrame:
    """A subject passes unless it has a finding of severity ``error``."""
    return findings.groupBy(*by).agg(
        F.bool_and(F.col("severity") != "error").alias("passed"),
        F.count(F.lit(1)).alias("findings"),
        F.min(F.struct("line", "code")).getField("code").alias("first_code"),
    )
