"""Counters and histograms over the record corpus and the events, batch and streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parity.operators import metrics
from parity.plans import corpus
from parity.plans.catalog import query, table
from parity.session import scratch_path
from parity.sources import records as facts
from parity.streaming import metrics as streams


def _hist_sql(ctes: str, source: str, value: str, buckets: Sequence[float], labels: Sequence[str] = ()) -> str:
    """Histogram rows stated as one conditional count per bucket."""
    names = "".join(f"{c}, " for c in labels)
    group = f"GROUP BY {', '.join(labels)}" if labels else ""
    rows = []
    for b in buckets:
        bound = "TRUE" if b == metrics.INF else f"{value} <= {b!r}"
        rows.append(
            f"SELECT {names}'{metrics.bucket_label(b)}' AS le, count(*) FILTER ({bound})::BIGINT AS bucket, "
            f"round(coalesce(sum({value}), 0), 6) AS sum, count({value})::BIGINT AS count FROM ({source}) {group}"
        )
    return (f"WITH {ctes}\n" if ctes else "") + "\nUNION ALL ".join(rows)


def _rounded(hist: DataFrame) -> DataFrame:
    return hist.withColumn("sum", F.round("sum", 6))


@query(
    "m_migrations",
    f"""
WITH {corpus.R}
SELECT CASE WHEN failed THEN 'failed' ELSE 'succeeded' END AS outcome, CASE WHEN has_plan THEN planned ELSE 'low' END AS risk,
       count(*)::BIGINT AS value FROM r GROUP BY 1, 2
""",
)
def m_migrations(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.migrations(corpus.newest(spark, sf, "plan"))


@query(
    "m_duration_hist",
    _hist_sql(
        f"{corpus.R}, {corpus.STAGES_SQL}",
        "SELECT CASE WHEN failed THEN 'failed' ELSE 'succeeded' END AS outcome, coalesce(t.secs, 0.0) AS secs "
        "FROM r LEFT JOIN (SELECT k, sum(seconds) AS secs FROM sg GROUP BY k) t USING (k)",
        "secs",
        metrics.MIGRATION_BUCKETS,
        ["outcome"],
    ),
)
def m_duration_hist(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.migration_duration(corpus.newest(spark, sf, "stages")))


@query(
    "m_stage_hist",
    _hist_sql(
        f"{corpus.R}, {corpus.STAGES_SQL}",
        "SELECT stage, seconds FROM sg WHERE seconds IS NOT NULL",
        "seconds",
        metrics.STAGE_BUCKETS,
        ["stage"],
    ),
)
def m_stage_hist(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.stage_duration(corpus.newest(spark, sf, "stages")))


@query(
    "m_checks",
    f"""
WITH {corpus.R}, {corpus.CHECKS_SQL}
SELECT name AS "check", CASE WHEN skipped THEN 'skip' WHEN passed THEN 'pass' ELSE 'fail' END AS result,
       count(*)::BIGINT AS value FROM ck GROUP BY 1, 2
""",
)
def m_checks(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.validation_checks(corpus.newest(spark, sf, "validation"))


@query(
    "m_validations",
    f"WITH {corpus.R}, {corpus.CHECKS_SQL} SELECT status, count(*)::BIGINT AS value FROM st GROUP BY 1",
)
def m_validations(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.validations(corpus.newest(spark, sf, "validation"))


@query(
    "m_repair_attempts",
    f"""
WITH {corpus.R}, {corpus.REPAIRS_SQL}
SELECT CASE WHEN NOT admitted THEN 'refused' WHEN succeeded THEN 'fixed' ELSE 'did_not_fix' END AS outcome,
       count(*)::BIGINT AS value FROM rp GROUP BY 1
""",
)
def m_repair_attempts(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.repair_attempts(corpus.newest(spark, sf, "repair"))


@query(
    "m_repairs",
    f"""
WITH {corpus.R}
SELECT CASE WHEN k % 4 = 3 THEN 'succeeded' ELSE 'exhausted' END AS outcome, count(*)::BIGINT AS value
FROM r WHERE has_repair GROUP BY 1
""",
)
def m_repairs(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.repairs(corpus.newest(spark, sf, "repair"))


@query(
    "m_opt_verdicts",
    f"""
WITH {corpus.R}, {corpus.TRIES_SQL}
SELECT CASE WHEN accepted THEN 'accepted' WHEN NOT admitted AND e % 16 = 0 THEN 'declined' WHEN NOT admitted THEN 'refused_repeat'
       WHEN NOT measured AND status = 'FAIL' THEN 'rejected_correctness' WHEN NOT measured THEN 'rejected_gate'
       WHEN status IS DISTINCT FROM 'PASS' THEN 'rejected_correctness' WHEN inconclusive THEN 'rejected_inconclusive'
       WHEN NOT robust THEN 'rejected_not_robust' ELSE 'rejected_below_threshold' END AS verdict, count(*)::BIGINT AS value
FROM tr GROUP BY 1
""",
)
def m_opt_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.optimization_attempts(corpus.newest(spark, sf, "optimization"))


@query(
    "m_speedup_hist",
    _hist_sql(
        f"{corpus.R}, {corpus.OUTCOME_SQL}",
        "SELECT speedup FROM oc WHERE applied",
        "speedup",
        metrics.SPEEDUP_BUCKETS,
    ),
)
def m_speedup_hist(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.optimization_speedup(corpus.newest(spark, sf, "optimization")))


@query(
    "m_noise_hist",
    _hist_sql(
        f"{corpus.R}, {corpus.TRIES_SQL}",
        "SELECT 'baseline' AS role, b_noise AS noise FROM tr WHERE measured AND NOT b_failed AND b_n >= 2 "
        "UNION ALL SELECT 'candidate', c_noise FROM tr WHERE measured AND NOT c_failed AND c_n >= 2",
        "noise",
        metrics.NOISE_BUCKETS,
        ["role"],
    ),
)
def m_noise_hist(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.benchmark_noise(corpus.newest(spark, sf, "optimization")))


@query(
    "m_exec_hist",
    _hist_sql(
        corpus.R,
        "SELECT 'pandas' AS engine, (k % 50) / 8.0::DOUBLE + 0.25 AS secs FROM r WHERE has_val AND k % 17 <> 0 "
        "UNION ALL SELECT 'spark', (k % 400) / 2.0::DOUBLE + 1.0 FROM r WHERE has_val AND k % 19 <> 0",
        "secs",
        metrics.EXECUTION_BUCKETS,
        ["engine"],
    ),
)
def m_exec_hist(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.execution_duration(corpus.newest(spark, sf, "validation")))


def telemetry(spark: SparkSession, sf: str) -> DataFrame:
    """Agent invocations: one per event, with as many tools as the event id says."""
    tools = F.filter(F.sequence(F.lit(0), (F.col("event_id") % 4).cast("int")), lambda i: i < F.col("event_id") % 4)
    return table(spark, sf, "events").select(
        F.col("event_type").alias("agent"),
        F.col("value").alias("duration_seconds"),
        F.transform(tools, lambda i: F.concat(F.lit("tool"), i.cast("string"))).alias("tools_used"),
    )


@query(
    "m_agent_hist",
    _hist_sql("", "SELECT event_type AS agent, value FROM events", "value", metrics.STAGE_BUCKETS, ["agent"]),
)
def m_agent_hist(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.agent_duration(telemetry(spark, sf)))


@query(
    "m_agent_tools",
    "SELECT event_type AS agent, sum(event_id % 4)::BIGINT AS value FROM events GROUP BY 1",
)
def m_agent_tools(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.agent_tool_calls(telemetry(spark, sf))


@query("m_gate", f"WITH {corpus.R} SELECT sum(k % 3 + 1)::BIGINT AS value FROM r WHERE has_code")
def m_gate(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.gate_submissions(corpus.newest(spark, sf, "codegen"))


@query(
    "m_deliveries",
    f"""
WITH {corpus.R}
SELECT CASE WHEN k % 10 = 0 THEN 'refused' ELSE (['ready', 'draft', 'refused'])[(k % 3)::INT + 1] END AS disposition,
       count(*)::BIGINT AS value FROM r WHERE has_del GROUP BY 1
""",
)
def m_deliveries(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.delivery_outcomes(corpus.newest(spark, sf, "delivery"))


@query("m_violations", f"WITH {corpus.R} SELECT sum(k % 3)::BIGINT AS value FROM r WHERE has_del")
def m_violations(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.claim_violations(corpus.newest(spark, sf, "delivery"))


@query(
    "histogram",
    _hist_sql("", "SELECT l_returnflag AS flag, l_quantity FROM lineitem", "l_quantity", (5.0, 10.0, 25.0, 40.0, metrics.INF), ["flag"]),
)
def histogram(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_quantity")
    return _rounded(metrics.histogram(lines, "l_quantity", (5.0, 10.0, 25.0, 40.0, metrics.INF), ["flag"]))


@query(
    "hist_quantile",
    """
WITH b(lo, hi) AS (VALUES (0.0, 0.1), (0.1, 0.5), (0.5, 1.0), (1.0, 5.0), (5.0, 15.0), (15.0, 30.0), (30.0, 60.0),
                          (60.0, 180.0), (180.0, 600.0), (600.0, 'inf'::DOUBLE)),
h AS (SELECT event_type AS agent, lo, hi, count(*) FILTER (value <= hi) AS cum, count(*) FILTER (value <= lo) AS below,
             count(*) AS n FROM events, b GROUP BY 1, 2, 3),
q AS (SELECT unnest([0.5, 0.95]) AS q)
SELECT agent, q, round(CASE WHEN hi = 'inf'::DOUBLE THEN lo ELSE lo + (hi - lo) * (q * n - below) / (cum - below) END, 6) AS quantile
FROM h, q WHERE cum >= q * n QUALIFY row_number() OVER (PARTITION BY agent, q ORDER BY hi) = 1
""",
)
def hist_quantile(spark: SparkSession, sf: str) -> DataFrame:
    hist = metrics.agent_duration(telemetry(spark, sf))
    parts = [
        metrics.histogram_quantile(hist, q, ["agent"]).select(
            "agent", F.lit(q).alias("q"), F.round("quantile", 6).alias("quantile")
        )
        for q in (0.5, 0.95)
    ]
    return parts[0].unionByName(parts[1])


def _window_text(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("window_start", "window_end")}
    )


_SLIDING = """
w AS (SELECT event_type, value, time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR * s AS ws FROM events, range(4) t(s))
"""
_SLIDING_SQL = f"""
WITH {_SLIDING}
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(ws + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end,
       event_type, count(*)::BIGINT AS value FROM w GROUP BY ws, event_type
"""
_TUMBLING_SQL = """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
       strftime(date_trunc('day', ts) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end, event_type,
       count(*)::BIGINT AS value FROM events GROUP BY date_trunc('day', ts), event_type
"""


@query("counts_by_window", _SLIDING_SQL)
def counts_by_window(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    return _window_text(metrics.increase(events, "ts", ["event_type"], "1 day", "6 hours"))


@query(
    "label_audit",
    f"""
WITH {corpus.R}, {corpus.CHECKS_SQL}
SELECT 'check' AS label, name AS value, count(*)::BIGINT AS rows FROM ck WHERE name NOT IN ('schema', 'row_count') GROUP BY 2
UNION ALL SELECT 'result', 'skip', count(*) FROM ck WHERE skipped
""",
)
def label_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Checked against label sets that are too small, so that there is something to find."""
    from parity.sources.records import explode_checks

    result = F.when(F.col("skipped"), "skip").when(F.col("passed"), "pass").otherwise("fail")
    series = explode_checks(corpus.newest(spark, sf, "validation")).select(F.col("name").alias("check"), result.alias("result"))
    return metrics.label_audit(series, {"check": ("schema", "row_count"), "result": ("pass", "fail")})


@query(
    "amounts_by_window",
    """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
       strftime(date_trunc('day', ts) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end,
       event_type, sum(event_id % 7)::BIGINT AS value
FROM events GROUP BY ALL
""",
)
def amounts_by_window(spark: SparkSession, sf: str) -> DataFrame:
    """The increase of a counter that each row moves by an amount."""
    events = table(spark, sf, "events").withColumn("moved", F.col("event_id") % 7)
    return _window_text(metrics.increase(events, "ts", ["event_type"], "1 day", amount="moved"))


# --- streams ------------------------------------------------------------------------------------------


WINDOW_KEYS = ["window_start", "window_end", "event_type"]


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    return streams.read_file_stream(spark, sf, table(spark, sf, "events").schema, "events.parquet")


@query(
    "stream_dedup",
    "SELECT event_id, event_type, value FROM events",
)
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every event sent twice is counted once."""
    twice = event_stream(spark, sf).union(event_stream(spark, sf))
    once = streams.dedup_stream(twice, ["event_id"], "ts", "1 hour")
    return streams.run_to_files(once.select("event_id", "event_type", "value"), "dedup")


@query("stream_tumbling", _TUMBLING_SQL)
def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    events = streams.watermarked(event_stream(spark, sf), "ts", "1 hour")
    counts = streams.window_counts(events, "ts", ["event_type"], "1 day")
    return _window_text(streams.run_to_latest(counts, "tumbling", WINDOW_KEYS))


@query("stream_sliding", _SLIDING_SQL)
def stream_sliding(spark: SparkSession, sf: str) -> DataFrame:
    events = streams.watermarked(event_stream(spark, sf), "ts", "1 hour")
    counts = streams.window_counts(events, "ts", ["event_type"], "1 day", "6 hours")
    return _window_text(streams.run_to_latest(counts, "sliding", WINDOW_KEYS))


@query(
    "stream_histogram",
    _hist_sql(
        "",
        "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, "
        "strftime(date_trunc('day', ts) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end, event_type, value FROM events",
        "value",
        metrics.STAGE_BUCKETS,
        ["window_start", "window_end", "event_type"],
    ),
)
def stream_histogram(spark: SparkSession, sf: str) -> DataFrame:
    events = streams.watermarked(event_stream(spark, sf), "ts", "1 hour")
    hist = streams.window_histogram(events, "ts", "value", metrics.STAGE_BUCKETS, ["event_type"], "1 day")
    return _window_text(_rounded(streams.run_to_latest(hist, "histogram", [*WINDOW_KEYS, "le"])))


@query(
    "stream_late",
    f"""
SELECT * FROM ({_TUMBLING_SQL}) WHERE strptime(window_end, '%Y-%m-%d %H:%M:%S') <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
""",
)
def stream_late(spark: SparkSession, sf: str) -> DataFrame:
    """Append mode gives a window out once, when the watermark has passed its end; open ones stay in state."""
    events = streams.watermarked(event_stream(spark, sf), "ts", "1 hour")
    counts = streams.window_counts(events, "ts", ["event_type"], "1 day")
    return _window_text(streams.run_to_files(counts, "late"))


#: Records of these orders arrive in a second batch of files, after the newest of all others.
_HELD_BACK = "o_orderkey % 5 = 2"
_LATE_DAYS = "30"
#: Files of a batch.
_ARRIVING = 3


def _late_sql(select: str) -> str:
    return f"""
WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS TIMESTAMP) AS d, {_HELD_BACK} AS held FROM orders),
t AS (SELECT max(d) - INTERVAL {_LATE_DAYS} DAY AS mark FROM o WHERE NOT held),
j AS (SELECT d, k % 11 = 0 AS failed, date_trunc('day', d) AS w,
             held AND date_trunc('day', d) + INTERVAL 1 DAY <= (SELECT mark FROM t) AS late FROM o)
{select}
"""


def _record_stream(spark: SparkSession, sf: str, name: str) -> tuple[DataFrame, DataFrame]:
    """The corpus as a stream of two batches of files, the second of which holds records of days long past."""
    path = scratch_path(spark, name)
    records = corpus.newest(spark, sf, "validation")
    key = F.substring("migration_id", 2, 20).cast("bigint")
    held = F.expr(_HELD_BACK.replace("o_orderkey", "k"))
    lines = records.select(F.to_json(F.struct(*[c for c in records.columns if c != "modified_at"])).alias("value"), key.alias("k"))
    for wanted in (~held, held):
        lines.filter(wanted).select("value").repartition(_ARRIVING).write.mode("append").text(path)
    stream = facts.stream_records(spark, path, files_per_trigger=_ARRIVING)
    return streams.split_late(stream, "created_at", ["failed"], "1 day", f"{_LATE_DAYS} DAYS", f"{name}-out")


@query(
    "stream_records_counted",
    _late_sql("""SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(w + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end,
       failed, count(*)::BIGINT AS value FROM j WHERE NOT late GROUP BY ALL"""),
)
def stream_records_counted(spark: SparkSession, sf: str) -> DataFrame:
    """Records counted by day as they arrive; what comes after its day is final does not change it."""
    return _window_text(_record_stream(spark, sf, "record-stream")[0])


@query("stream_records_rejected", _late_sql("SELECT failed, count(*)::BIGINT AS value FROM j WHERE late GROUP BY ALL"))
def stream_records_rejected(spark: SparkSession, sf: str) -> DataFrame:
    """The late records of the same stream, counted by label instead of vanishing."""
    return _record_stream(spark, sf, "record-late")[1]
