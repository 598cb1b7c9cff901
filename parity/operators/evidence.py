"""Track records of strategies over a corpus of run records.

A rate is reported only above a minimum number of attempts; below it the answer is null, not a number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parity.operators.bench import array_speedup
from parity.operators.quantiles import MEDIAN, order_statistics
from parity.operators.windows import drop_duplicates
from parity.session import pinned
from parity.sources.records import (
    explode_optimizations,
    explode_repairs,
    semantic_differences,
    validation_status,
)

# Attempts needed before a rate is reported, and the rate at which it discourages.
MIN_SUPPORT = 3
DISCOURAGED_RATE = 0.34


def distinct_records(records: DataFrame, newest: str = "modified_at", tiebreak: Sequence[str] = ()) -> DataFrame:
    """Each run once, its newest copy."""
    marked = records.withColumn("__age", -F.unix_micros(F.col(newest).cast("timestamp")))
    return drop_duplicates(marked, ["migration_id"], "first", ["__age", *tiebreak]).drop("__age")


def totals(records: DataFrame) -> DataFrame:
    """``migrations_observed, validated, sufficient``; records are already distinct."""
    n = F.count(F.lit(1))
    passed = F.count_if(F.coalesce(validation_status() == "PASS", F.lit(False)))
    return records.agg(
        n.alias("migrations_observed"), passed.alias("validated"), (n >= MIN_SUPPORT).alias("sufficient")
    )


def repair_attempts(records: DataFrame) -> DataFrame:
    """Admitted repair attempts as ``key, migration_id, success``; a refused one was never tried."""
    admitted = explode_repairs(records).filter("admitted and approach is not null")
    return admitted.select(
        F.concat_ws("/", "category", "approach").alias("key"), "migration_id", F.col("succeeded").alias("success")
    )


def optimization_attempts(records: DataFrame) -> DataFrame:
    """Admitted optimisation attempts as ``key, migration_id, success, speedup, predicted``.

    Speedups and predictions are kept from accepted attempts only.
    """
    measured = F.col("accepted") & F.col("comparison").isNotNull()
    speedup = F.expr(array_speedup("comparison.baseline.durations", "comparison.candidate.durations"))
    return (
        explode_optimizations(records)
        .filter("admitted")
        .select(
            F.col("approach").alias("key"),
            "migration_id",
            F.col("accepted").alias("success"),
            F.when(measured, speedup).alias("speedup"),
            F.when(measured, F.col("expected_speedup")).alias("predicted"),
        )
    )


def evidence(attempts: DataFrame, key: str = "key", min_support: int = MIN_SUPPORT) -> DataFrame:
    """``key, attempts, successes, migrations, rate, discouraged`` per strategy, and with speedups
    ``speedups, median_speedup, median_predicted, optimism``."""
    measured = "speedup" in attempts.columns
    if measured:
        # exact medians read the attempts a number of times, and behind them lies the deduplication of whole records
        attempts = pinned(attempts)
    n = F.count(F.lit(1))
    grouped = attempts.groupBy(key).agg(
        n.alias("attempts"),
        F.count_if("success").alias("successes"),
        F.count_distinct("migration_id").alias("migrations"),
    )
    rated = with_rates(grouped, min_support)
    if not measured:
        return rated
    for column, count, median in (
        ("speedup", "speedups", "median_speedup"),
        ("predicted", "predictions", "median_predicted"),
    ):
        medians = order_statistics(attempts, [key], column, {median: MEDIAN}).select(
            F.col(key).alias("__key"), F.col("n").alias(count), median
        )
        rated = rated.join(medians, rated[key].eqNullSafe(medians["__key"]), "left").drop("__key")
    known = (F.col("speedups") >= min_support) & (F.col("predictions") >= min_support)
    return rated.withColumns(
        {
            "speedups": F.coalesce("speedups", F.lit(0)),
            "optimism": F.when(known, F.col("median_predicted") - F.col("median_speedup")),
        }
    ).drop("predictions")


def with_rates(grouped: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Add ``rate`` (null under the support) and ``discouraged``."""
    enough = F.col("attempts") >= min_support
    rate = F.when(enough, F.col("successes") / F.col("attempts"))
    return grouped.withColumn("rate", rate).withColumn(
        "discouraged", F.coalesce(F.col("rate") <= DISCOURAGED_RATE, F.lit(False))
    )


def discouraged(table: DataFrame, key: str = "key") -> DataFrame:
    """Strategies with enough evidence, most of it bad, by key."""
    return table.filter("discouraged").orderBy(key)


def lookup(table: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """Evidence for the asked keys; an unseen key has zero attempts and no rate."""
    found = table.withColumnRenamed(key, "__key")
    joined = keys.join(found, keys[key].eqNullSafe(found["__key"]), "left").drop("__key")
    zeros: dict[str, Column] = {
        c: F.coalesce(c, F.lit(0)) for c in ("attempts", "successes", "migrations") if c in table.columns
    }
    zeros["discouraged"] = F.coalesce("discouraged", F.lit(False))
    return joined.withColumns(zeros)


def outcomes_by_category(records: DataFrame) -> DataFrame:
    """``category, passed, total`` over the differences that plans declared, for validated-or-not runs
    that have both a plan and a validation."""
    both = records.filter(F.col("plan").isNotNull() & F.col("validation").isNotNull())
    rows = both.select(
        F.explode(semantic_differences()).alias("d"), (validation_status() == "PASS").alias("ok")
    )
    return rows.groupBy(F.col("d.category").alias("category")).agg(
        F.count_if("ok").alias("passed"), F.count(F.lit(1)).alias("total")
    )
