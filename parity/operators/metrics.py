"""Counters and histograms over run records.

Everything is a grouping whose partial results are combined before the shuffle, so each function
works on a batch frame and, where no join is involved, on a stream. Labels come from bounded sets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parity.operators.bench import array_noise, judged_attempts
from parity.operators.delivery import outcome_speedup
from parity.operators.stats import literal_rows
from parity.sources.records import (
    explode_checks,
    explode_optimizations,
    explode_repairs,
    explode_stages,
    risk,
    total_duration,
    validation_status,
)

INF = float("inf")

# Histogram bucket bounds.
MIGRATION_BUCKETS = (10.0, 30.0, 60.0, 120.0, 300.0, 600.0, 1800.0, 3600.0, INF)
STAGE_BUCKETS = (0.1, 0.5, 1.0, 5.0, 15.0, 30.0, 60.0, 180.0, 600.0, INF)
EXECUTION_BUCKETS = (1.0, 5.0, 10.0, 20.0, 40.0, 80.0, 160.0, 320.0, INF)
SPEEDUP_BUCKETS = (1.0, 1.05, 1.10, 1.25, 1.5, 2.0, 3.0, 5.0, INF)
NOISE_BUCKETS = (0.01, 0.02, 0.05, 0.10, 0.25, 0.50, 1.0, INF)

# The classes of an optimisation attempt.
VERDICTS = (
    "accepted",
    "declined",
    "refused_repeat",
    "rejected_gate",
    "rejected_correctness",
    "rejected_inconclusive",
    "rejected_not_robust",
    "rejected_below_threshold",
)
DECLINED_REASON = "no grounded opportunity"


# --- builders ------------------------------------------------------------------------------------------


def counter(df: DataFrame, labels: Sequence[str | Column], amount: Column | None = None) -> DataFrame:
    """``labels..., value``: rows, or a summed amount, per label combination."""
    value = F.count(F.lit(1)) if amount is None else F.coalesce(F.sum(amount), F.lit(0))
    return df.groupBy(*labels).agg(value.cast("bigint").alias("value"))


def bucket_label(bound: float) -> str:
    return "+Inf" if bound == INF else repr(bound)


def bucket_counts(value: Column, buckets: Sequence[float]) -> list[Column]:
    """One conditional count per bound; the last one counts every observation."""
    return [
        (F.count(value) if b == INF else F.count_if(value <= b)).alias(f"__b{i}")
        for i, b in enumerate(buckets)
    ]


def histogram(
    df: DataFrame, value: str, buckets: Sequence[float], labels: Sequence[str | Column] = ()
) -> DataFrame:
    """``labels..., le, bucket, sum, count``: cumulative buckets, like a scraped histogram.

    All buckets are counted in one pass over the rows, none is joined.
    """
    v = F.col(value)
    columns = [
        *bucket_counts(v, buckets),
        F.coalesce(F.sum(v), F.lit(0.0)).alias("sum"),
        F.count(v).alias("count"),
    ]
    grouped = df.groupBy(*labels).agg(*columns)
    names = [c for c in grouped.columns if not c.startswith("__b") and c not in ("sum", "count")]
    rows = F.array(
        *[
            F.struct(F.lit(bucket_label(b)).alias("le"), F.col(f"__b{i}").alias("bucket"))
            for i, b in enumerate(buckets)
        ]
    )
    return grouped.select(*names, F.inline(rows), "sum", "count")


def le_value() -> Column:
    return F.when(F.col("le") == "+Inf", F.lit(INF)).otherwise(F.col("le").try_cast("double"))


def histogram_quantile(hist: DataFrame, q: float, labels: Sequence[str] = ()) -> DataFrame:
    """``labels..., quantile``: linear interpolation inside the bucket that reaches rank q.

    As usual for scraped histograms the lowest bucket starts at 0 (unless its bound is not positive)
    and the unbounded one yields the highest finite bound. Windows here span one label set's buckets.
    """
    by_bound = Window.partitionBy(*labels).orderBy("__le")
    rows = hist.withColumn("__le", le_value())
    rank = F.lit(float(q)) * F.col("count")
    before = rows.withColumns(
        {
            "__below": F.coalesce(F.lag("bucket").over(by_bound), F.lit(0)),
            "__from": F.coalesce(F.lag("__le").over(by_bound), F.lit(0.0)),
        }
    )
    inside = F.col("bucket") - F.col("__below")
    # the lowest bucket cannot be interpolated from 0 when it ends at or below it
    start = F.when(F.col("__le") <= 0, F.col("__le")).otherwise(F.col("__from"))
    at = (
        F.when(F.col("__le") == INF, F.col("__from"))
        .when(inside == 0, F.col("__le"))
        .otherwise(start + (F.col("__le") - start) * (rank - F.col("__below")) / inside)
    )
    hit = F.when((F.col("bucket") >= rank) & (F.col("count") > 0), F.struct(F.col("__le").alias("le"), at.alias("v")))
    picked = before.groupBy(*labels).agg(F.min(hit).alias("h"))
    return picked.select(*labels, F.col("h.v").alias("quantile"))


def increase(
    df: DataFrame, ts: str, labels: Sequence[str], size: str, slide: str | None = None, amount: str | None = None
) -> DataFrame:
    """``window_start, window_end, labels..., value``: rows per trailing window, or the sum of ``amount``."""
    window = F.window(F.col(ts).cast("timestamp"), size, slide) if slide else F.window(F.col(ts).cast("timestamp"), size)
    value = F.count(F.lit(1)) if amount is None else F.coalesce(F.sum(amount), F.lit(0))
    grouped = df.groupBy(window.alias("w"), *labels).agg(value.alias("value"))
    return grouped.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *labels, "value"
    )


def label_audit(series: DataFrame, allowed: dict[str, Sequence[str]]) -> DataFrame:
    """Label values outside their bounded set: ``label, value, rows``. No rows means all is well."""
    spark = series.sparkSession
    cells = F.array(
        *[F.struct(F.lit(k).alias("label"), F.col(k).cast("string").alias("value")) for k in allowed]
    )
    seen = series.select(F.inline(cells)).groupBy("label", "value").agg(F.count(F.lit(1)).alias("rows"))
    table = literal_rows(
        spark, "l string, v string", [(k, v) for k, values in allowed.items() for v in values]
    )
    return seen.join(table, (F.col("label") == F.col("l")) & F.col("value").eqNullSafe(F.col("v")), "left_anti")


# --- families over distinct records ----------------------------------------------------------------------


def _outcome() -> Column:
    return F.when(F.coalesce("failed", F.lit(False)), "failed").otherwise("succeeded").alias("outcome")


def migrations(records: DataFrame) -> DataFrame:
    return counter(records, [_outcome(), risk().alias("risk")])


def migration_duration(records: DataFrame) -> DataFrame:
    rows = records.select(_outcome(), total_duration().alias("seconds"))
    return histogram(rows, "seconds", MIGRATION_BUCKETS, ["outcome"])


def stage_duration(records: DataFrame) -> DataFrame:
    rows = explode_stages(records).filter(F.col("seconds").isNotNull())
    return histogram(rows, "seconds", STAGE_BUCKETS, ["stage"])


def validation_checks(records: DataFrame) -> DataFrame:
    result = F.when(F.col("skipped"), "skip").when(F.col("passed"), "pass").otherwise("fail")
    return counter(explode_checks(records), [F.col("name").alias("check"), result.alias("result")])


def validations(records: DataFrame) -> DataFrame:
    rows = records.filter(F.col("validation").isNotNull())
    return counter(rows, [validation_status().alias("status")])


def repair_attempts(records: DataFrame) -> DataFrame:
    outcome = F.when(~F.col("admitted"), "refused").when(F.col("succeeded"), "fixed").otherwise("did_not_fix")
    return counter(explode_repairs(records), [outcome.alias("outcome")])


def repairs(records: DataFrame) -> DataFrame:
    rows = records.filter(F.col("repair").isNotNull())
    outcome = F.when(F.coalesce("repair.succeeded", F.lit(False)), "succeeded").otherwise("exhausted")
    return counter(rows, [outcome.alias("outcome")])


def optimization_verdict() -> Column:
    """Class of an attempt, from its fields alone; needs the columns of ``judged_attempts``."""
    reason = F.coalesce("rejection_reason", F.lit(""))
    status = F.col("validation_status")
    return (
        F.when(F.col("accepted"), "accepted")
        .when(~F.col("admitted"), F.when(F.contains(reason, F.lit(DECLINED_REASON)), "declined").otherwise("refused_repeat"))
        .when(
            F.col("comparison").isNull(),
            F.when(status.isNotNull() & (status != "PASS"), "rejected_correctness").otherwise("rejected_gate"),
        )
        .when(status.isNull() | (status != "PASS"), "rejected_correctness")
        .when(F.col("inconclusive"), "rejected_inconclusive")
        .when(~F.col("robust"), "rejected_not_robust")
        .otherwise("rejected_below_threshold")
    )


def optimization_attempts(records: DataFrame) -> DataFrame:
    return counter(judged_attempts(explode_optimizations(records)), [optimization_verdict().alias("verdict")])


def optimization_speedup(records: DataFrame) -> DataFrame:
    rows = records.filter(F.coalesce("optimization.applied", F.lit(False)))
    return histogram(rows.selectExpr(f"{outcome_speedup()} AS speedup"), "speedup", SPEEDUP_BUCKETS)


def benchmark_noise(records: DataFrame) -> DataFrame:
    attempts = explode_optimizations(records).filter(F.col("comparison").isNotNull())
    sides = F.array(
        *[
            F.struct(
                F.lit(role).alias("role"),
                F.coalesce(F.col(f"comparison.{role}.failed"), F.lit(False)).alias("failed"),
                F.col(f"comparison.{role}.durations").alias("durations"),
            )
            for role in ("baseline", "candidate")
        ]
    )
    rows = attempts.select(F.inline(sides)).filter(~F.col("failed") & (F.size("durations") >= 2))
    measured = rows.selectExpr("role", f"{array_noise('durations')} AS noise")
    return histogram(measured, "noise", NOISE_BUCKETS, ["role"])


def execution_duration(records: DataFrame) -> DataFrame:
    runs = F.array_compact(F.array("validation.legacy_execution", "validation.spark_execution"))
    rows = records.select(F.inline(runs)).filter("succeeded")
    return histogram(rows, "duration_seconds", EXECUTION_BUCKETS, ["engine"])


def agent_duration(telemetry: DataFrame) -> DataFrame:
    return histogram(telemetry.filter("agent is not null"), "duration_seconds", STAGE_BUCKETS, ["agent"])


def agent_tool_calls(telemetry: DataFrame) -> DataFrame:
    used = telemetry.filter(F.col("agent").isNotNull() & (F.size("tools_used") > 0))
    return counter(used, ["agent"], F.size("tools_used"))


def gate_submissions(records: DataFrame) -> DataFrame:
    return counter(records.filter(F.col("codegen").isNotNull()), [], F.col("codegen.gate_iterations"))


def delivery_outcomes(records: DataFrame) -> DataFrame:
    rows = records.filter(F.col("delivery").isNotNull())
    return counter(rows, [F.coalesce("delivery.decision.disposition", F.lit("refused")).alias("disposition")])


def claim_violations(records: DataFrame) -> DataFrame:
    found = F.col("delivery.audit.violations")
    return counter(records, [], F.when(found.isNotNull(), F.size(found)).otherwise(0))
