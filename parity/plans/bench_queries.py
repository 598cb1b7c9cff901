"""Benchmark statistics over timings taken from the events.

A configuration is an event type on one of seven machines; its runs are the event values. One in
twenty runs is a warm-up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parity.operators import bench
from parity.plans.catalog import query, table


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        (F.col("user_id") % 7).alias("machine"),
        F.col("event_type").alias("config"),
        F.col("value").alias("duration"),
        (F.col("event_id") % 20 == 0).alias("is_warmup"),
        ((F.col("user_id") % 7 == 3) & (F.col("event_type") == "view")).alias("failed"),
    )


STATS = """
e AS (SELECT user_id % 7 AS machine, event_type AS config, value AS v, event_id % 20 = 0 AS warm,
             user_id % 7 = 3 AND event_type = 'view' AS bad FROM events),
c AS (SELECT *, row_number() OVER (PARTITION BY machine, config ORDER BY v) - 1 AS rn,
             count(*) OVER (PARTITION BY machine, config) AS n,
             median(v) OVER (PARTITION BY machine, config) AS m FROM e WHERE NOT warm),
s AS (SELECT machine, config, bool_or(bad) AS failed, count(*) AS samples, any_value(m) AS med,
             max(CASE WHEN rn = round_even(0.75 * (n - 1), 0) THEN v END) AS p75,
             1.4826 * median(abs(v - m)) / any_value(m) AS noise,
             count(*) FILTER (abs(v - m) > 0.5 * m) AS outliers FROM c GROUP BY machine, config)
"""

PAIRS = f"""
{STATS},
p AS (SELECT x.machine, x.config, y.med / x.med AS speedup,
             x.failed OR y.failed OR x.samples < 2 OR y.samples < 2 OR greatest(x.noise, y.noise) > 0.8 AS inconclusive,
             x.p75 < y.med AS robust
      FROM s x JOIN s y ON x.machine = y.machine AND y.config = 'error' AND x.config <> 'error')
"""


@query(
    "bench_stats",
    f"""
WITH {STATS}
SELECT machine, config, samples::BIGINT AS samples, failed, round(med, 9) AS median, round(p75, 9) AS p75 FROM s
""",
)
def bench_stats(spark: SparkSession, sf: str) -> DataFrame:
    found = bench.bench_stats(runs(spark, sf), ["machine", "config"])
    return found.select(
        "machine", "config", "samples", "failed", F.round("median", 9).alias("median"), F.round("p75", 9).alias("p75")
    )


@query(
    "bench_noise",
    f"WITH {STATS} SELECT machine, config, round(noise, 9) AS noise_ratio, outliers::BIGINT AS outliers FROM s",
)
def bench_noise(spark: SparkSession, sf: str) -> DataFrame:
    found = bench.bench_stats(runs(spark, sf), ["machine", "config"])
    return found.select("machine", "config", F.round("noise_ratio", 9).alias("noise_ratio"), "outliers")


def _compared(spark: SparkSession, sf: str) -> DataFrame:
    found = bench.bench_stats(runs(spark, sf), ["machine", "config"])
    return bench.bench_compare(found, "config", "error", ["machine"], max_noise=0.8)


@query(
    "bench_compare",
    f"""
WITH {PAIRS}
SELECT machine, config, round(speedup, 9) AS speedup, inconclusive, robust,
       NOT inconclusive AND speedup >= 1.1 AND robust AS improved FROM p
""",
)
def bench_compare(spark: SparkSession, sf: str) -> DataFrame:
    return _compared(spark, sf).select(
        "machine", "config", F.round("speedup", 9).alias("speedup"), "inconclusive", "robust", "improved"
    )


@query(
    "bench_verdict",
    f"""
WITH {PAIRS}, q AS (SELECT *, CASE WHEN config = 'click' THEN NULL WHEN machine = 2 THEN 'FAIL' ELSE 'PASS' END AS st FROM p)
SELECT machine, config, CASE WHEN st IS NULL THEN 'unverified' WHEN st <> 'PASS' THEN 'rejected_correctness'
       WHEN inconclusive THEN 'rejected_inconclusive' WHEN NOT robust THEN 'rejected_not_robust'
       WHEN speedup < 1.1 THEN 'rejected_below_threshold' ELSE 'accepted' END AS verdict FROM q
""",
)
def bench_verdict(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("config") == "click", None).when(F.col("machine") == 2, "FAIL").otherwise("PASS")
    judged = bench.bench_verdict(_compared(spark, sf).withColumn("status", status), "status")
    return judged.select("machine", "config", "verdict")


@query(
    "bench_first_accepted",
    """
WITH a AS (SELECT user_id, event_id, ts, CASE WHEN event_id % 40 = 1 THEN 'no_change' ELSE event_type || (event_id % 9) END AS app,
                  value > 30 AS ok FROM events),
t AS (SELECT *, row_number() OVER (PARTITION BY user_id, app ORDER BY ts, event_id) = 1 AS first FROM a),
s AS (SELECT *, coalesce(max(CASE WHEN first AND (ok OR app = 'no_change') THEN 1 ELSE 0 END) OVER (
             PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS stopped FROM t)
SELECT user_id, event_id, CASE WHEN stopped THEN 'not_reached' WHEN app = 'no_change' THEN 'declined'
       WHEN NOT first THEN 'refused_repeat' WHEN ok THEN 'accepted' ELSE 'rejected' END AS outcome FROM s
""",
)
def bench_first_accepted(spark: SparkSession, sf: str) -> DataFrame:
    attempts = table(spark, sf, "events").select(
        "user_id",
        "event_id",
        F.struct("ts", "event_id").alias("n"),
        F.when(F.col("event_id") % 40 == 1, bench.NO_CHANGE)
        .otherwise(F.concat("event_type", (F.col("event_id") % 9).cast("string")))
        .alias("approach"),
        (F.col("value") > 30).alias("accepted"),
    )
    done = bench.first_accepted(attempts, "user_id", "n", "approach", "accepted")
    return done.select("user_id", "event_id", "outcome")
