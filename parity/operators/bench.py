"""Robust statistics of repeated timings, comparisons with a baseline, and acceptance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parity.operators.joins import null_safe
from parity.operators.quantiles import MEDIAN, P75, order_statistics

# Thresholds of the acceptance rules.
MIN_SPEEDUP = 1.10
MAX_NOISE_RATIO = 0.25
MAD_SCALE = 1.4826
OUTLIER_SHARE = 0.5
MIN_SAMPLES = 2
NO_CHANGE = "no_change"


# --- timings as rows: any number of runs per configuration --------------------------------------------


def bench_stats(runs: DataFrame, by: Sequence[str], value: str = "duration") -> DataFrame:
    """``by, samples, failed, median, p75, noise_ratio, outliers`` per configuration.

    ``runs`` may have ``is_warmup`` (such rows do not count) and ``failed``. A configuration
    without counted runs has zeros.
    """
    runs = runs.select(
        *by,
        F.col(value).cast("double").alias("__v"),
        (F.col("is_warmup") if "is_warmup" in runs.columns else F.lit(False)).alias("__warm"),
        (F.col("failed") if "failed" in runs.columns else F.lit(False)).alias("__failed"),
    )
    counted = runs.filter(~F.col("__warm")).select(*by, "__v")
    groups = runs.groupBy(*by).agg(F.bool_or("__failed").alias("failed"))
    center = order_statistics(counted, by, "__v", {"median": MEDIAN, "p75": P75})
    renamed = center.withColumnsRenamed({k: f"__k_{k}" for k in by})

    def on(left: DataFrame) -> Column:
        return null_safe([(left[k], renamed[f"__k_{k}"]) for k in by])

    deviations = counted.join(renamed, on(counted)).select(
        *by, F.abs(F.col("__v") - F.col("median")).alias("__d"), "median"
    )
    spread = order_statistics(deviations, by, "__d", {"mad": MEDIAN})
    far = deviations.groupBy(*by).agg(
        F.count_if(F.col("__d") > OUTLIER_SHARE * F.col("median")).alias("far")
    )
    result = groups
    for part, columns in ((center, ("n", "median", "p75")), (spread, ("mad",)), (far, ("far",))):
        named = part.select(*[F.col(k).alias(f"__k_{k}") for k in by], *columns)
        pairs = [(result[k], named[f"__k_{k}"]) for k in by]
        result = result.join(named, null_safe(pairs), "left").drop(*[f"__k_{k}" for k in by])
    measurable = F.col("median") > 0
    noise = F.when((F.col("n") >= 2) & measurable, MAD_SCALE * F.col("mad") / F.col("median"))
    return result.select(
        *by,
        F.coalesce("n", F.lit(0)).cast("bigint").alias("samples"),
        "failed",
        F.coalesce("median", F.lit(0.0)).alias("median"),
        F.coalesce("p75", F.lit(0.0)).alias("p75"),
        F.coalesce(noise, F.lit(0.0)).alias("noise_ratio"),
        F.coalesce(F.when(measurable, F.col("far")), F.lit(0)).cast("bigint").alias("outliers"),
    )


def judged(
    compared: DataFrame, min_speedup: Column | float = MIN_SPEEDUP, max_noise: Column | float = MAX_NOISE_RATIO
) -> DataFrame:
    """Add ``speedup, inconclusive, robust, improved`` to rows with ``base_*`` and ``cand_*`` statistics."""
    limit = max_noise if isinstance(max_noise, Column) else F.lit(max_noise)
    threshold = min_speedup if isinstance(min_speedup, Column) else F.lit(min_speedup)
    b, c = (lambda n: F.col(f"base_{n}")), (lambda n: F.col(f"cand_{n}"))
    speedup = F.when((b("median") > 0) & (c("median") > 0), b("median") / c("median")).otherwise(0.0)
    inconclusive = (
        b("failed") | c("failed")
        | (b("samples") < MIN_SAMPLES) | (c("samples") < MIN_SAMPLES)
        | (F.greatest(b("noise_ratio"), c("noise_ratio")) > limit)
    )
    robust = (b("median") > 0) & (c("p75") > 0) & (c("p75") < b("median"))
    return compared.withColumns(
        {"speedup": speedup, "inconclusive": inconclusive, "robust": robust}
    ).withColumn(
        "improved", ~F.col("inconclusive") & (F.col("speedup") >= threshold) & F.col("robust")
    )


STATISTICS = ("samples", "failed", "median", "p75", "noise_ratio", "outliers")


def bench_compare(
    stats: DataFrame, label: str, baseline: str, by: Sequence[str] = (), **thresholds: float
) -> DataFrame:
    """Every other configuration against the one labelled ``baseline``, within each ``by`` group.

    The baseline has one row per group, so the join adds none.
    """
    base = stats.filter(F.col(label) == baseline).select(
        *[F.col(k).alias(f"__b_{k}") for k in by],
        *[F.col(c).alias(f"base_{c}") for c in STATISTICS],
        F.lit(1).alias("__one"),
    )
    cand = stats.filter(F.col(label) != baseline).select(
        *by, label, *[F.col(c).alias(f"cand_{c}") for c in STATISTICS], F.lit(1).alias("__one_c")
    )
    pairs = [(cand[k], base[f"__b_{k}"]) for k in by] or [(F.col("__one_c"), F.col("__one"))]
    joined = cand.join(base, null_safe(pairs)).drop("__one", "__one_c", *[f"__b_{k}" for k in by])
    return judged(joined, thresholds.get("min_speedup", MIN_SPEEDUP), thresholds.get("max_noise", MAX_NOISE_RATIO))


def bench_verdict(compared: DataFrame, status: str, min_speedup: float = MIN_SPEEDUP) -> DataFrame:
    """Add ``accepted`` and ``verdict``. Correctness is settled before speed is looked at."""
    s = F.col(status)
    verdict = (
        F.when(s.isNull(), "unverified")
        .when(s != "PASS", "rejected_correctness")
        .when(F.col("inconclusive"), "rejected_inconclusive")
        .when(~F.col("robust"), "rejected_not_robust")
        .when(F.col("speedup") < min_speedup, "rejected_below_threshold")
        .otherwise("accepted")
    )
    return compared.withColumn("verdict", verdict).withColumn("accepted", F.col("verdict") == "accepted")


def first_accepted(
    attempts: DataFrame,
    subject: str,
    order: str,
    approach: str,
    accepted: str,
    no_change: str = NO_CHANGE,
) -> DataFrame:
    """What became of each proposed attempt: measured, refused as a repeat, declined, or never reached.

    Within a subject an approach is tried once; the first acceptance, or giving up (``no_change``),
    ends the sequence. Both facts are minima per key, so no subject is ever sorted or gathered.
    """
    first = attempts.groupBy(subject, approach).agg(
        F.min(F.struct(F.col(order).alias("n"), F.col(accepted).alias("ok"))).alias("__first")
    )
    ends = (
        first.filter(F.col("__first.ok") | (F.col(approach) == no_change))
        .groupBy(subject)
        .agg(F.min("__first.n").alias("__end"))
        .withColumnRenamed(subject, "__end_of")
    )
    firsts = first.select(
        F.col(subject).alias("__s"), F.col(approach).alias("__a"), F.col("__first.n").alias("__n")
    )
    rows = attempts.join(
        firsts, attempts[subject].eqNullSafe(F.col("__s")) & attempts[approach].eqNullSafe(F.col("__a"))
    ).join(ends, F.col(subject).eqNullSafe(F.col("__end_of")), "left")
    outcome = (
        F.when(F.col(order) > F.col("__end"), "not_reached")
        .when(F.col(approach) == no_change, "declined")
        .when(F.col(order) > F.col("__n"), "refused_repeat")
        .when(F.col(accepted), "accepted")
        .otherwise("rejected")
    )
    return rows.withColumn("outcome", outcome).drop("__s", "__a", "__n", "__end", "__end_of")


def kept_speedup(attempts: DataFrame, subject: str, speedup: str) -> DataFrame:
    """The speedup a subject ends up with: the accepted attempt's, or 1.0."""
    kept = F.max(F.when(F.col("outcome") == "accepted", F.col(speedup)))
    return attempts.groupBy(subject).agg(F.coalesce(kept, F.lit(1.0)).alias("kept_speedup"))


# --- timings as an array: the few runs one record holds (SQL text in, SQL text out) ---------------------


def array_median(durations: str) -> str:
    """Median of a short array, 0.0 when empty or missing."""
    middle = "(o[(size(o) - 1) div 2] + o[size(o) div 2]) / 2"
    return f"transform(array(array_sort({durations})), o -> if(size(o) > 0, {middle}, 0.0D))[0]"


def array_p75(durations: str) -> str:
    at = "o[CAST(rint((size(o) - 1) * 0.75D) AS INT)]"
    return f"transform(array(array_sort({durations})), o -> if(size(o) > 0, {at}, 0.0D))[0]"


def array_noise(durations: str) -> str:
    deviations = array_median(f"transform({durations}, v -> abs(v - m))")
    ratio = f"if(size({durations}) > 1 AND m > 0, {MAD_SCALE}D * {deviations} / m, 0.0D)"
    return f"transform(array({array_median(durations)}), m -> {ratio})[0]"


def array_speedup(baseline: str, candidate: str) -> str:
    """Baseline median over candidate median, 0.0 when either is not positive."""
    medians = f"array(struct({array_median(baseline)} AS b, {array_median(candidate)} AS c))"
    return f"transform({medians}, p -> if(p.b > 0 AND p.c > 0, p.b / p.c, 0.0D))[0]"


def judged_attempts(attempts: DataFrame) -> DataFrame:
    """Optimisation attempts with the verdict columns of their measured comparison (null without one)."""
    columns = {}
    for prefix, side in (("base", "baseline"), ("cand", "candidate")):
        durations = f"comparison.{side}.durations"
        texts = {
            "samples": f"greatest(coalesce(size({durations}), 0), 0)",
            "failed": f"coalesce(comparison.{side}.failed, false)",
            "median": array_median(durations),
            "p75": array_p75(durations),
            "noise_ratio": array_noise(durations),
        }
        columns |= {f"{prefix}_{name}": F.expr(text) for name, text in texts.items()}
    return judged(
        attempts.withColumns(columns),
        F.expr(f"coalesce(comparison.min_speedup, {MIN_SPEEDUP}D)"),
        F.expr(f"coalesce(comparison.max_noise_ratio, {MAX_NOISE_RATIO}D)"),
    )
