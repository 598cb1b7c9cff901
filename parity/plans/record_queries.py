"""Evidence, ledger, lifecycle, delivery and claim operators over the record corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parity.functions.text import LINE_END, WHITE_SPACE, fingerprint
from parity.operators import compare, delivery, evidence, ledger, lifecycle
from parity.plans import corpus
from parity.plans.catalog import query, table
from parity.session import scratch_path
from parity.sources import records as facts


def _with_text(df: DataFrame, column: str) -> DataFrame:
    """An array column as one text, so that any engine compares it the same way."""
    return df.withColumn(column, F.array_join(column, ","))


# --- record files -----------------------------------------------------------------------------------

#: Documents in a compressed file of the corpus: such a file is read by one task.
_DOCUMENTS = 20_000


@query(
    "scan_records",
    f"""
WITH {corpus.R}, {corpus.CHECKS_SQL}
SELECT CASE WHEN r.k % 50 <> 0 THEN id END AS migration_id, CASE WHEN r.k % 50 <> 0 THEN st.status END AS status,
       r.k % 50 <> 0 AS readable FROM r LEFT JOIN (SELECT k, status FROM st) st ON st.k = r.k
""",
)
def scan_records(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus written as JSON documents, one in fifty cut off in the middle, and read back."""
    path = scratch_path(spark, "records")
    records = corpus.newest(spark, sf)
    k = F.substring("migration_id", 2, 20).cast("bigint")
    whole = F.to_json(F.struct(*[c for c in records.columns if c != "modified_at"]))
    cut = F.expr("substring(doc, 1, length(doc) div 2)")
    documents = records.select(whole.alias("doc"), k.alias("k"))
    shown = documents.select(F.when(F.col("k") % 50 == 0, cut).otherwise(F.col("doc")))
    shown.write.option("maxRecordsPerFile", _DOCUMENTS).text(path, compression="gzip")
    found = facts.scan_records(spark, path, limit=None, pattern="*.txt.gz", lines=True)
    return found.select(
        F.when(F.col("readable"), F.col("migration_id")).alias("migration_id"),
        F.when(F.col("readable"), facts.validation_status()).alias("status"),
        "readable",
    )


#: Batches of record files, the files of each, and how many of the files are the newest ones asked for.
_BATCHES, _FILES, _NEWEST = 6, 3, 6


@query(
    "newest_records",
    f"""
WITH {corpus.R}, {corpus.CHECKS_SQL}
SELECT CASE WHEN r.k % 50 <> 0 THEN id END AS migration_id, CASE WHEN r.k % 50 <> 0 THEN st.status END AS status,
       r.k % 50 <> 0 AS readable
FROM r LEFT JOIN (SELECT k, status FROM st) st ON st.k = r.k WHERE r.k % {_BATCHES} >= {_BATCHES - _NEWEST // _FILES}
""",
)
def newest_records(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus written in batches, one after another, and of all its files the newest ones read: those of the last
    batches. A document that is cut off does not make its file older."""
    path = scratch_path(spark, "newest")
    records = corpus.newest(spark, sf)
    whole = F.to_json(F.struct(*[c for c in records.columns if c != "modified_at"]))
    documents = records.select(whole.alias("doc"), F.substring("migration_id", 2, 20).cast("bigint").alias("k"))
    cut = F.when(F.col("k") % 50 == 0, F.expr("substring(doc, 1, length(doc) div 2)")).otherwise(F.col("doc"))
    for batch in range(_BATCHES):
        rows = documents.filter(F.col("k") % _BATCHES == batch).select(cut.alias("doc"))
        rows.repartition(_FILES).write.text(f"{path}/batch-{batch}", compression="gzip")
    found = facts.scan_records(spark, path, limit=_NEWEST, pattern="batch-*/*.txt.gz", lines=True)
    return found.select(
        F.when(F.col("readable"), F.col("migration_id")).alias("migration_id"),
        F.when(F.col("readable"), facts.validation_status()).alias("status"),
        "readable",
    )


# --- harvest ----------------------------------------------------------------------------------------


@query(
    "harvest_dedup",
    f"WITH {corpus.R}, {corpus.CHECKS_SQL} SELECT r.id AS migration_id, failed, status FROM r LEFT JOIN st ON st.k = r.k",
)
def harvest_dedup(spark: SparkSession, sf: str) -> DataFrame:
    distinct = evidence.distinct_records(corpus.records(spark, sf, "validation"))
    return distinct.select("migration_id", "failed", facts.validation_status().alias("status"))


@query(
    "harvest_totals",
    f"""
WITH {corpus.R}, {corpus.CHECKS_SQL}
SELECT (SELECT count(*) FROM r)::BIGINT AS migrations_observed,
       (SELECT count(*) FROM st WHERE status = 'PASS')::BIGINT AS validated,
       (SELECT count(*) FROM r) >= 3 AS sufficient
""",
)
def harvest_totals(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.totals(evidence.distinct_records(corpus.records(spark, sf, "validation")))


@query(
    "harvest_repairs",
    f"""
WITH {corpus.R}, {corpus.REPAIRS_SQL}
SELECT category || '/' || approach AS key, count(*)::BIGINT AS attempts,
       count(*) FILTER (succeeded)::BIGINT AS successes, count(DISTINCT id)::BIGINT AS migrations
FROM rp WHERE admitted GROUP BY 1
""",
)
def harvest_repairs(spark: SparkSession, sf: str) -> DataFrame:
    distinct = evidence.distinct_records(corpus.records(spark, sf, "repair"))
    found = evidence.evidence(evidence.repair_attempts(distinct))
    return found.select("key", "attempts", "successes", "migrations")


@query(
    "harvest_optimizations",
    f"""
WITH {corpus.R}, {corpus.TRIES_SQL}
SELECT approach AS key, count(*)::BIGINT AS attempts, count(*) FILTER (accepted)::BIGINT AS successes,
       count(DISTINCT id)::BIGINT AS migrations, count(speedup) FILTER (accepted)::BIGINT AS speedups
FROM tr WHERE admitted GROUP BY 1
""",
)
def harvest_optimizations(spark: SparkSession, sf: str) -> DataFrame:
    distinct = evidence.distinct_records(corpus.records(spark, sf, "optimization"))
    found = evidence.evidence(evidence.optimization_attempts(distinct))
    return found.select("key", "attempts", "successes", "migrations", "speedups")


# evidence per (approach, source file): many thin track records beside thick ones
_THIN = """
thin AS (SELECT approach || '@' || (k % 100) AS key, count(*) AS attempts, count(*) FILTER (succeeded) AS successes
         FROM rp WHERE admitted GROUP BY 1)
"""


def _thin(spark: SparkSession, sf: str) -> DataFrame:
    distinct = evidence.distinct_records(corpus.records(spark, sf, "repair"))
    rows = facts.explode_repairs(distinct).filter("admitted")
    source = distinct.select("migration_id", F.regexp_extract("source_path", r"(\d+)", 1).alias("src"))
    keyed = rows.join(source, "migration_id").select(
        F.concat_ws("@", "approach", "src").alias("key"), "migration_id", F.col("succeeded").alias("success")
    )
    return evidence.evidence(keyed)


@query(
    "evidence_rates",
    f"""
WITH {corpus.R}, {corpus.REPAIRS_SQL}, {_THIN}
SELECT key, attempts::BIGINT AS attempts, round(CASE WHEN attempts >= 3 THEN successes / attempts END, 9) AS rate
FROM thin
""",
)
def evidence_rates(spark: SparkSession, sf: str) -> DataFrame:
    return _thin(spark, sf).select("key", "attempts", F.round("rate", 9).alias("rate"))


@query(
    "evidence_discouraged",
    f"""
WITH {corpus.R}, {corpus.REPAIRS_SQL}, {_THIN}
SELECT key FROM thin WHERE attempts >= 3 AND successes / attempts <= 0.34 ORDER BY key
""",
)
def evidence_discouraged(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.discouraged(_thin(spark, sf)).select("key")


@query(
    "evidence_speedups",
    f"""
WITH {corpus.R}, {corpus.TRIES_SQL},
g AS (SELECT approach AS key, median(speedup) FILTER (accepted) AS ms, median(predicted) FILTER (accepted AND measured) AS mp,
             count(speedup) FILTER (accepted) AS n FROM tr WHERE admitted GROUP BY 1)
SELECT key, round(ms, 9) AS median_speedup, round(CASE WHEN n >= 3 THEN mp - ms END, 9) AS optimism FROM g
""",
)
def evidence_speedups(spark: SparkSession, sf: str) -> DataFrame:
    distinct = evidence.distinct_records(corpus.records(spark, sf, "optimization"))
    found = evidence.evidence(evidence.optimization_attempts(distinct))
    return found.select(
        "key", F.round("median_speedup", 9).alias("median_speedup"), F.round("optimism", 9).alias("optimism")
    )


@query(
    "evidence_lookup",
    f"""
WITH {corpus.R}, {corpus.REPAIRS_SQL},
seen AS (SELECT category || '/' || approach AS key, count(*) AS attempts, count(*) FILTER (succeeded) AS successes
         FROM rp WHERE admitted GROUP BY 1),
asked AS (SELECT DISTINCT o_orderpriority || '/fix_1' AS key FROM orders
          UNION SELECT DISTINCT category || '/fix_' || (k % 9) FROM rp)
SELECT key, coalesce(attempts, 0)::BIGINT AS attempts, coalesce(successes, 0)::BIGINT AS successes
FROM asked LEFT JOIN seen USING (key)
""",
)
def evidence_lookup(spark: SparkSession, sf: str) -> DataFrame:
    distinct = evidence.distinct_records(corpus.records(spark, sf, "repair"))
    attempts = facts.explode_repairs(distinct)
    known = evidence.evidence(evidence.repair_attempts(distinct))
    k = F.substring("migration_id", 2, 20).cast("bigint")
    proposed = attempts.select(
        F.concat(F.col("category"), F.lit("/fix_"), (k % 9).cast("string")).alias("key")
    )
    unseen = table(spark, sf, "orders").select(F.concat("o_orderpriority", F.lit("/fix_1")).alias("key"))
    asked = proposed.union(unseen).distinct()
    return evidence.lookup(known, asked).select("key", "attempts", "successes")


@query(
    "outcomes_by_category",
    f"""
WITH {corpus.R}, {corpus.CHECKS_SQL}, {corpus.DECLARED_SQL}
SELECT category, count(*) FILTER (status = 'PASS')::BIGINT AS passed, count(*)::BIGINT AS total
FROM pd JOIN st ON st.k = pd.k GROUP BY category
""",
)
def outcomes_by_category(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.outcomes_by_category(evidence.distinct_records(corpus.records(spark, sf, "plan", "validation")))


# --- verdicts of stored reports ----------------------------------------------------------------------


@query(
    "diff_verdict",
    f"""
WITH {corpus.R}, {corpus.CHECKS_SQL}
SELECT id AS migration_id, status, n::BIGINT AS checks, n_failed::BIGINT AS failed FROM st
""",
)
def diff_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return compare.verdict(facts.explode_checks(corpus.newest(spark, sf, "validation")), ["migration_id"])


@query(
    "diff_summary",
    f"""
WITH {corpus.R}, {corpus.CHECKS_SQL}
SELECT id AS migration_id, bool_or(name = 'schema' AND passed AND NOT skipped) AS schema_match,
       bool_or(name = 'row_count' AND passed AND NOT skipped) AS row_count_match,
       bool_or(name = 'numeric_tolerance' AND passed AND NOT skipped) AS numeric_tolerance_passed,
       coalesce(string_agg(CASE WHEN NOT passed OR skipped THEN name END, ',' ORDER BY name), '') AS failed_checks
FROM ck GROUP BY id
""",
)
def diff_summary(spark: SparkSession, sf: str) -> DataFrame:
    flat = compare.summary(facts.explode_checks(corpus.newest(spark, sf, "validation")), ["migration_id"])
    return _with_text(flat, "failed_checks")


@query(
    "diff_external_check",
    f"""
WITH {corpus.R}, {corpus.CHECKS_SQL}
SELECT id AS migration_id, CASE WHEN status <> 'PASS' OR k % 4 <> 0 THEN status
       WHEN k % 3 = 0 AND k % 2 = 0 THEN 'PASS' ELSE 'FAIL' END AS status
FROM st
""",
)
def diff_external_check(spark: SparkSession, sf: str) -> DataFrame:
    """The test run of a record, where there is one, counts as one more check of its report."""
    records = corpus.newest(spark, sf, "validation")
    checks = facts.explode_checks(records).select("migration_id", "name", "passed", "skipped")
    run = F.col("validation.test_run")
    tests = records.filter(run.isNotNull()).select(
        "migration_id",
        F.lit("generated_tests").alias("name"),
        ((run["failed"] == 0) & (run["errors"] == 0)).alias("passed"),
        F.lit(False).alias("skipped"),
    )
    return compare.verdict(checks.unionByName(tests), ["migration_id"]).select("migration_id", "status")


@query(
    "required_checks",
    f"""
WITH {corpus.R}, {corpus.DECLARED_SQL},
w AS (SELECT id, name, min(o) AS o FROM (
        SELECT id, 'schema' AS name, 0 AS o FROM r WHERE has_plan
        UNION ALL SELECT id, 'row_count', 1 FROM r WHERE has_plan
        UNION ALL SELECT id, wanted, 2 + 10 * s + i FROM pd) GROUP BY id, name)
SELECT id, name, (row_number() OVER (PARTITION BY id ORDER BY o) - 1)::INT AS ordinal,
       name IN ('schema', 'row_count', 'null_counts', 'duplicate_counts', 'aggregate_checksums',
                'column_statistics', 'numeric_tolerance') AS known
FROM w
""",
)
def required_checks(spark: SparkSession, sf: str) -> DataFrame:
    planned = corpus.newest(spark, sf, "plan").filter("plan is not null")
    plans = planned.select(
        F.col("migration_id").alias("id"),
        F.col("plan.validation_plan.required_checks").alias("required"),
        F.transform(facts.semantic_differences(), lambda d: d["validation_check"]).alias("declared"),
    )
    return compare.required_checks(plans)


@query(
    "diff_by_category",
    f"""
WITH {corpus.R}, {corpus.CHECKS_SQL},
d AS (SELECT {corpus._sql_pick(corpus.CATEGORIES, "i + j")} AS category, 'c' || j AS col FROM ck, range(3) t(j) WHERE j < nd)
SELECT category, count(*)::BIGINT AS differences, string_agg(DISTINCT col, ',' ORDER BY col) AS columns
FROM d GROUP BY category
""",
)
def diff_by_category(spark: SparkSession, sf: str) -> DataFrame:
    found = facts.explode_differences(corpus.newest(spark, sf, "validation"))
    return _with_text(compare.by_category(found), "columns")


# --- repair ledger ------------------------------------------------------------------------------------


def _re(pattern: str) -> str:
    return pattern.replace("'", "''")


@query(
    "text_fingerprint",
    f"""
SELECT doc_id, sha256(array_to_string(list_transform(
         list_filter(regexp_split_to_array(text, '{_re(LINE_END)}'),
                     lambda l: NOT regexp_matches(l, '^{_re(WHITE_SPACE)}*(#|$)')),
         lambda l: regexp_replace(l, '{_re(WHITE_SPACE)}+$', '')), chr(10))) AS fingerprint
FROM documents
""",
)
def text_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", fingerprint(F.col("text")).alias("fingerprint"))


# Attempts of a user in event order. The code is named by a small number, so that repeats occur.
_LEDGER = """
WITH RECURSIVE a AS (
  SELECT user_id AS subject, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt,
         event_type || ':' || (event_id % 3) AS sig, 'code' || (floor(value)::BIGINT % 12) AS fp FROM events),
f AS (
  SELECT subject, attempt, sig, fp, [] ::VARCHAR[] AS sigs, ['code0'] AS fps, NULL::VARCHAR AS reason, FALSE AS ok
  FROM a WHERE FALSE
  UNION ALL
  SELECT subject, 0, NULL, NULL, []::VARCHAR[], ['code0'], NULL, FALSE FROM (SELECT DISTINCT subject FROM a)
  UNION ALL
  SELECT f.subject, a.attempt, a.sig, a.fp,
         CASE WHEN NOT list_contains(f.sigs, a.sig) AND NOT list_contains(f.fps, a.fp) THEN list_append(f.sigs, a.sig) ELSE f.sigs END,
         CASE WHEN NOT list_contains(f.sigs, a.sig) AND NOT list_contains(f.fps, a.fp) THEN list_append(f.fps, a.fp) ELSE f.fps END,
         CASE WHEN list_contains(f.sigs, a.sig) THEN 'strategy_repeated' WHEN a.fp = 'code0' THEN 'code_unchanged'
              WHEN list_contains(f.fps, a.fp) THEN 'code_repeated' END,
         NOT list_contains(f.sigs, a.sig) AND NOT list_contains(f.fps, a.fp)
  FROM f JOIN a ON a.subject = f.subject AND a.attempt = f.attempt + 1)
SELECT subject, attempt, ok AS admitted, reason FROM f WHERE attempt > 0
"""


def ledger_attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts numbered per user. Numbering needs an order only, so the event id stands for it."""
    events = table(spark, sf, "events")
    return events.select(
        F.col("user_id").alias("subject"),
        F.struct("ts", "event_id").alias("attempt"),
        F.concat_ws(":", "event_type", (F.col("event_id") % 3).cast("string")).alias("signature"),
        F.concat(F.lit("code"), (F.floor("value") % 12).cast("string")).alias("fingerprint"),
        F.lit("code0").alias("baseline"),
        "event_id",
    )


@query(
    "ledger_admission",
    _LEDGER.replace(
        "SELECT subject, attempt, ok AS admitted, reason FROM f WHERE attempt > 0",
        """SELECT subject, event_id, ok AS admitted, reason FROM f JOIN
  (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
  ON user_id = subject AND n = attempt WHERE attempt > 0""",
    ),
)
def ledger_admission(spark: SparkSession, sf: str) -> DataFrame:
    judged = ledger.admit(ledger_attempts(spark, sf))
    return judged.select("subject", "event_id", "admitted", "reason")


@query(
    "best_attempt",
    f"""
WITH {corpus.R}, {corpus.REPAIRS_SQL}
SELECT id AS migration_id, attempt::INT AS attempt, differences::INT AS differences FROM rp
WHERE admitted AND differences IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY id ORDER BY differences, attempt) = 1
""",
)
def best_attempt(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.best_attempt(facts.explode_repairs(corpus.newest(spark, sf, "repair")))


@query(
    "repair_outcomes",
    f"""
WITH {corpus.R}, {corpus.REPAIRS_SQL}
SELECT id AS migration_id, count(*)::BIGINT AS attempts_used, bool_or(admitted AND succeeded) AS succeeded,
       NOT bool_or(admitted AND succeeded) AND count(*) >= 3 AS exhausted
FROM rp GROUP BY id
""",
)
def repair_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.repair_outcomes(facts.explode_repairs(corpus.newest(spark, sf, "repair")), max_attempts=3)


# --- lifecycle ------------------------------------------------------------------------------------------


@query(
    "stage_durations",
    f"""
WITH {corpus.R}, {corpus.STAGES_SQL}
SELECT id AS migration_id, coalesce(sum(seconds), 0.0) AS total_seconds, count(seconds)::BIGINT AS closed_stages
FROM sg GROUP BY id
""",
)
def stage_durations(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.stage_durations(facts.explode_stages(corpus.newest(spark, sf, "stages")))


@query(
    "resume_points",
    f"""
WITH {corpus.R}, {corpus.STAGES_SQL},
o AS (SELECT i, {corpus._sql_pick(corpus.STAGES, "i")} AS stage FROM range(7) t(i)),
todo AS (SELECT r.id, min(o.i) AS i FROM r CROSS JOIN o
         WHERE (o.stage <> 'approval' OR (has_plan AND r.k % 2 = 0))
           AND NOT EXISTS (SELECT 1 FROM sg WHERE sg.k = r.k AND sg.stage = o.stage AND sg.succeeded)
         GROUP BY r.id)
SELECT r.id AS migration_id, coalesce(o.stage, 'optimization') AS resume_at
FROM r LEFT JOIN todo ON todo.id = r.id LEFT JOIN o ON o.i = todo.i
""",
)
def resume_points(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.resume_points(corpus.newest(spark, sf, "plan", "stages"))


@query(
    "risk_rollup",
    f"""
WITH {corpus.R},
s AS (SELECT k, max((k + 2 * i) % 3) AS top FROM r, range(2) t(i) WHERE k % 4 <> 1 AND i < k % 3 GROUP BY k)
SELECT id AS migration_id,
       coalesce(CASE WHEN has_plan THEN planned END, (['low', 'medium', 'high'])[top::INT + 1], 'low') AS risk,
       has_plan AND planned = 'high' AS requires_approval
FROM r LEFT JOIN s ON s.k = r.k
""",
)
def risk_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.risk_rollup(corpus.newest(spark, sf, "plan", "spec"))


@query(
    "findings_pass",
    f"""
WITH {corpus.R},
f AS (SELECT id, 'G' || ((k + i) % 12) AS code, 100 - i AS line, (k + i) % 3 = 2 AS err
      FROM r, range(3) t(i) WHERE has_code AND i < k % 4)
SELECT id AS migration_id, NOT bool_or(err) AS passed, count(*)::BIGINT AS findings,
       arg_min(code, line) AS first_code
FROM f GROUP BY id
""",
)
def findings_pass(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.findings_pass(lifecycle.explode_findings(corpus.newest(spark, sf, "codegen")))


# --- delivery -------------------------------------------------------------------------------------------

_RULES = """
dr AS (SELECT r.*, st.status, NOT has_code AS a, has_val AND st.status <> 'PASS' AND NOT (has_repair AND r.k % 4 = 3) AS wrong
       FROM r LEFT JOIN st ON st.k = r.k)
"""


@query(
    "disposition",
    f"""
WITH {corpus.R}, {corpus.CHECKS_SQL}, {_RULES}
SELECT id AS migration_id, CASE WHEN a THEN 'refused' WHEN failed THEN 'draft' WHEN NOT has_val THEN 'refused'
       WHEN wrong THEN 'draft' ELSE 'ready' END AS disposition FROM dr
""",
)
def disposition(spark: SparkSession, sf: str) -> DataFrame:
    return delivery.deliveries(corpus.newest(spark, sf, "codegen", "validation", "repair", "plan", "spec", "optimization")).select("migration_id", "disposition")


@query(
    "disposition_labels",
    f"""
WITH {corpus.R}, {corpus.CHECKS_SQL}, {_RULES},
s AS (SELECT k, max((k + 2 * i) % 3) AS top FROM r, range(2) t(i) WHERE k % 4 <> 1 AND i < k % 3 GROUP BY k)
SELECT id AS migration_id, CASE WHEN a THEN '' WHEN failed THEN 'auto,needs-human,migration-failed'
       WHEN NOT has_val THEN '' WHEN wrong THEN 'auto,needs-human,validation-' || lower(status)
       ELSE 'auto' || CASE WHEN CASE WHEN has_plan THEN planned = 'high' ELSE coalesce(top = 2, FALSE) END THEN ',high-risk' ELSE '' END
            || CASE WHEN has_opt AND dr.k % 6 = 1 THEN ',optimised' ELSE '' END END AS labels
FROM dr LEFT JOIN s ON s.k = dr.k
""",
)
def disposition_labels(spark: SparkSession, sf: str) -> DataFrame:
    made = delivery.deliveries(corpus.newest(spark, sf, "codegen", "validation", "repair", "plan", "spec", "optimization"), origin="auto")
    return _with_text(made.select("migration_id", "labels"), "labels")


# --- claims ---------------------------------------------------------------------------------------------

#: One narrative per order: some of its numbers are the record's, some are not.
_TEXTS = """
tx AS (SELECT k, id, 'Moved job ' || k || ' (Python 3.11, 2 CSV files)' || chr(10)
       || 'It is ' || (k % 5) || '.25x faster. All ' || (k % 8) || ' checks passed; ' || (k * 37) || ' rows compared.'
       || chr(10) || 'The run kept ' || (k % 3) || ' semantic differences.' || chr(10)
       || 'After ' || (k % 6) || ' repair attempts and ' || (k % 20) || ' tests, 1' || chr(215) || ' as before.' AS text
       FROM r)
"""

_CLAIMS = """
cl AS (SELECT k, id, kind, claimed FROM (
       SELECT k, id, 'speedup' AS kind, unnest(regexp_extract_all(text, '(?i)(\\d+(?:\\.\\d+)?)\\s*(?:x\\b|\\x{D7})', 1)) AS claimed FROM tx
       UNION ALL SELECT k, id, 'checks', unnest(regexp_extract_all(text, '(?i)(\\d+)\\s+(?:of\\s+\\d+\\s+)?checks?\\b', 1)) FROM tx
       UNION ALL SELECT k, id, 'tests', unnest(regexp_extract_all(text, '(?i)(\\d+)\\s+tests?\\b', 1)) FROM tx
       UNION ALL SELECT k, id, 'rows', unnest(regexp_extract_all(text, '(?i)([\\d,]+)\\s+rows?\\b', 1)) FROM tx
       UNION ALL SELECT k, id, 'differences', unnest(regexp_extract_all(text, '(?i)(\\d+)\\s+(?:semantic\\s+)?(?:differences?|diffs?)\\b', 1)) FROM tx
       UNION ALL SELECT k, id, 'attempts', unnest(regexp_extract_all(text, '(?i)(\\d+)\\s+(?:repair\\s+)?attempts?\\b', 1)) FROM tx))
"""

_SUPPORTED = """
ns AS (SELECT k, count(*) AS n FROM rp GROUP BY k),
nt AS (SELECT k, count(*) AS n FROM tr0 GROUP BY k),
np AS (SELECT k, count(*) AS n FROM pd GROUP BY k),
sp AS (SELECT DISTINCT id, kind, value FROM (
       SELECT id, 'speedup' AS kind, unnest(['1', '1.0', '1.00']) AS value FROM r
       UNION ALL SELECT id, 'speedup', unnest([printf('%.2f', speedup), printf('%.1f', speedup), printf('%g', speedup)]) FROM oc JOIN r USING (k)
       UNION ALL SELECT id, 'speedup', unnest([printf('%.2f', predicted), printf('%.1f', predicted), printf('%g', predicted)])
                 FROM (SELECT id, predicted::DOUBLE AS predicted FROM tr0)
       UNION ALL SELECT id, 'attempts', coalesce(n, 0)::VARCHAR FROM r LEFT JOIN nt USING (k) WHERE has_opt
       UNION ALL SELECT id, 'attempts', coalesce(n, 0)::VARCHAR FROM r LEFT JOIN ns USING (k) WHERE has_repair
       UNION ALL SELECT id, 'checks', unnest([n, n_passed, n_failed])::VARCHAR FROM st
       UNION ALL SELECT id, 'differences', nd::VARCHAR FROM st
       UNION ALL SELECT id, 'rows', unnest([(k * 37)::VARCHAR, format('{:,}', k * 37), (k * 37 + k % 2)::VARCHAR, format('{:,}', k * 37 + k % 2)])
                 FROM r WHERE has_val
       UNION ALL SELECT id, 'tests', unnest([k % 20, k % 3, k % 2, k % 20 + k % 3 + k % 2 + k % 5])::VARCHAR
                 FROM r WHERE has_val AND k % 4 = 0
       UNION ALL SELECT id, 'differences', coalesce(n, 0)::VARCHAR FROM r LEFT JOIN np USING (k) WHERE has_plan))
"""

_CLAIM_BASE = ", ".join(
    part.strip()
    for part in (
        corpus.R, corpus.CHECKS_SQL, corpus.DECLARED_SQL, corpus.REPAIRS_SQL, corpus.TRIES_SQL,
        corpus.OUTCOME_SQL, _TEXTS, _CLAIMS, _SUPPORTED,
    )
)


def claim_texts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")

    def s(column):
        return column.cast("string")

    title = F.concat(F.lit("Moved job "), s(k), F.lit(" (Python 3.11, 2 CSV files)"))
    summary = F.concat(
        F.lit("It is "), s(k % 5), F.lit(".25x faster. All "), s(k % 8), F.lit(" checks passed; "),
        s(k * 37), F.lit(" rows compared."),
    )
    focus = F.array(F.concat(F.lit("The run kept "), s(k % 3), F.lit(" semantic differences.")))
    callouts = F.array(
        F.concat(
            F.lit("After "), s(k % 6), F.lit(" repair attempts and "), s(k % 20),
            F.lit(" tests, 1× as before."),
        )
    )
    return table(spark, sf, "orders").select(
        F.concat(F.lit("m"), s(k)).alias("id"),
        delivery.narrative_text(title, summary, focus, callouts).alias("text"),
    )


@query(
    "claims_extract",
    f"WITH {corpus.R}, {_TEXTS}, {_CLAIMS} SELECT id, kind, claimed FROM cl",
)
def claims_extract(spark: SparkSession, sf: str) -> DataFrame:
    return delivery.extract_claims(claim_texts(spark, sf)).select("id", "kind", "claimed")


@query("claims_supported", f"WITH {_CLAIM_BASE} SELECT id, kind, value FROM sp")
def claims_supported(spark: SparkSession, sf: str) -> DataFrame:
    return delivery.supported_numbers(corpus.newest(spark, sf, "plan", "validation", "repair", "optimization")).distinct()


@query(
    "claims_audit",
    f"""
WITH {_CLAIM_BASE},
v AS (SELECT id, kind, claimed FROM cl WHERE NOT EXISTS (
        SELECT 1 FROM sp WHERE sp.id = cl.id AND sp.kind = cl.kind AND replace(sp.value, ',', '') = replace(cl.claimed, ',', '')))
SELECT tx.id, coalesce(c.n, 0)::BIGINT AS checked, coalesce(b.n, 0)::BIGINT AS violations, coalesce(b.n, 0) = 0 AS passed
FROM tx LEFT JOIN (SELECT id, count(*) AS n FROM cl GROUP BY id) c ON c.id = tx.id
        LEFT JOIN (SELECT id, count(*) AS n FROM v GROUP BY id) b ON b.id = tx.id
""",
)
def claims_audit(spark: SparkSession, sf: str) -> DataFrame:
    records = corpus.newest(spark, sf, "plan", "validation", "repair", "optimization")
    return delivery.audit(claim_texts(spark, sf), records)


@query(
    "claims_excerpts",
    f"""
WITH {_CLAIM_BASE},
v AS (SELECT k, id, kind, claimed FROM cl WHERE NOT EXISTS (
        SELECT 1 FROM sp WHERE sp.id = cl.id AND sp.kind = cl.kind AND replace(sp.value, ',', '') = replace(cl.claimed, ',', '')))
SELECT id, kind, claimed, CASE kind
         WHEN 'speedup' THEN CASE WHEN claimed = '1' THEN NULL ELSE 'It is ' || (k % 5) || '.25x faster.' END
         WHEN 'checks' THEN 'All ' || (k % 8) || ' checks passed; ' || (k * 37) || ' rows compared.'
         WHEN 'rows' THEN 'All ' || (k % 8) || ' checks passed; ' || (k * 37) || ' rows compared.'
         WHEN 'differences' THEN 'The run kept ' || (k % 3) || ' semantic differences.'
         ELSE 'After ' || (k % 6) || ' repair attempts and ' || (k % 20) || ' tests, 1' || chr(215) || ' as before.' END AS excerpt
FROM v
""",
)
def claims_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    texts = claim_texts(spark, sf)
    supported = delivery.supported_numbers(corpus.newest(spark, sf, "plan", "validation", "repair", "optimization"))
    broken = delivery.violations(delivery.extract_claims(texts), supported)
    return delivery.excerpts(broken, texts, length=160).select("id", "kind", "claimed", "excerpt")


@query(
    "evidence_rows",
    f"""
WITH {corpus.R}, {corpus.CHECKS_SQL}, {corpus.REPAIRS_SQL}, {corpus.TRIES_SQL}, {corpus.STAGES_SQL}, {corpus.DECLARED_SQL},
{corpus.OUTCOME_SQL},
df AS (SELECT id, (row_number() OVER (PARTITION BY id ORDER BY i, j) - 1)::INT AS o,
              name || ' [c' || j || ']: reference=' || (k + j) || ' candidate=' || (k - j) AS t
       FROM ck, range(3) u(j) WHERE j < nd),
s AS (SELECT k, max((k + 2 * i) % 3) AS top FROM r, range(2) t(i) WHERE k % 4 <> 1 AND i < k % 3 GROUP BY k),
tot AS (SELECT k, count(*) AS n, coalesce(sum(seconds), 0.0) AS secs FROM sg GROUP BY k)
SELECT id, 'checks' AS section, i::INT AS ordinal,
       name || CASE WHEN skipped THEN ' skipped' WHEN passed THEN ' pass' ELSE ' fail' END AS text FROM ck
UNION ALL SELECT id, 'differences', o, t FROM df WHERE o < 10
UNION ALL SELECT id, 'repairs', (attempt - 1)::INT, category || ':' || approach
       || CASE WHEN NOT admitted THEN ' refused' WHEN succeeded THEN ' PASS' ELSE ' FAIL' END FROM rp
UNION ALL SELECT id, 'optimizations', i::INT, approach
       || CASE WHEN NOT admitted THEN ' refused' WHEN accepted THEN ' accepted' ELSE ' rejected' END FROM tr0
UNION ALL SELECT id, 'tests', 0, 'passed=' || (k % 20) || ' failed=' || (k % 3) || ' errors=' || (k % 2) || ' skipped=' || (k % 5)
          FROM r WHERE has_val AND k % 4 = 0
UNION ALL SELECT id, 'declared', (row_number() OVER (PARTITION BY id ORDER BY s, i) - 1)::INT, category || ' covered by ' || wanted FROM pd
UNION ALL SELECT id, 'performance', 0, 'baseline=' || printf('%.3f', b) || ' runs=4' FROM om JOIN r USING (k)
UNION ALL SELECT id, 'performance', 1, 'final=' || printf('%.3f', f) || ' runs=5' FROM om JOIN r USING (k)
UNION ALL SELECT id, 'performance', 2, 'speedup=' || printf('%.2f', speedup) FROM oc JOIN r USING (k) WHERE applied
UNION ALL SELECT id, 'provenance', 0, 'source=jobs/' || (k % 100) || '.py' FROM r
UNION ALL SELECT id, 'provenance', 1, 'risk=' || coalesce(CASE WHEN has_plan THEN planned END, (['low', 'medium', 'high'])[top::INT + 1], 'low')
          FROM r LEFT JOIN s USING (k)
UNION ALL SELECT id, 'provenance', 2, 'stages=' || coalesce(n, 0) FROM r LEFT JOIN tot USING (k)
UNION ALL SELECT id, 'provenance', 3, 'seconds=' || printf('%.1f', coalesce(secs, 0.0)::DOUBLE) FROM r LEFT JOIN tot USING (k)
""",
)
def evidence_rows(spark: SparkSession, sf: str) -> DataFrame:
    return delivery.evidence_rows(corpus.newest(spark, sf, "plan", "spec", "validation", "repair", "optimization", "stages"), most_differences=10)
