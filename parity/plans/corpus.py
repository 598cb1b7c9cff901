"""A corpus of run records derived from the driver tables, one record per order.

Every field is a rule on the order's key ``k``, written once for Spark and once for SQL (as fact
tables). Nothing is grouped to build a record, so the corpus scales with the orders and has no hot
run. Every fifth run was stored twice; the older copy says something else and must not count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from parity.plans.catalog import table
from parity.sources.records import record_schema

CATEGORIES = ("null_semantics", "type_coercion", "row_order", "duplicate_explosion", "floating_point")
CHECKS = (
    "schema", "row_count", "null_counts", "numeric_tolerance", "duplicate_counts", "aggregate_checksums",
)
STAGES = (
    "discovery", "planning", "approval", "code_generation", "static_analysis", "validation", "optimization",
)
APPROACHES = ("reduce_shuffle", "broadcast_small", "cache_inputs", "prune_columns", "no_udf")


def _sql_pick(values: tuple[str, ...], index: str) -> str:
    """DuckDB text: the value at an index modulo the number of values."""
    listed = ", ".join(f"'{v}'" for v in values)
    return f"([{listed}])[(({index}) % {len(values)})::INT + 1]"


def _pick(values: tuple[str, ...], index: str) -> str:
    """Spark text of the same."""
    listed = ", ".join(f"'{v}'" for v in values)
    return f"array({listed})[cast(({index}) % {len(values)} AS INT)]"


def _each(var: str, n: str, body: str) -> str:
    """Array of ``body`` for var = 0 .. n-1."""
    return f"transform(filter(sequence(0L, {n}), x -> x < {n}), {var} -> {body})"


def _bench(seed: str, n: str, scale: str, failed: str) -> str:
    durations = _each("q", n, f"{scale} + (({seed}) * (q + 3)) % 16 / 16.0D")
    return f"struct({durations}, {failed})"


_LEVELS = ("low", "medium", "high")

#: Spark text of each field of a record, and when it is present, from k (key), d (date), copy (0 or 1).
FIELDS = {
    "spec": ("k % 4 <> 1", "struct(" + _each(
        "i", "k % 3", f"struct({_pick(CATEGORIES, 'k + i')}, {_pick(_LEVELS, 'k + 2 * i')})") + ")"),
    "plan": ("k % 7 <> 0", f"""struct({_pick(_LEVELS, 'k')}, k % 2 = 0, """ + _each(
        "s", "k % 3", "struct(concat('s', s), 'aggregate', " + _each(
            "i", "(k + s) % 3",
            f"struct({_pick(CATEGORIES, 'k + s + i')}, "
            f"{_pick((*CHECKS, 'column_statistics', 'lineage'), 'k + s + 3 * i')})") + ")")
        + ", struct(array('id'), 1e-9D, array('schema', 'row_count')))"),
    "codegen": ("k % 13 <> 0", "struct(k % 3 + 1, struct('job.py', 'def run(): ...'), struct(true, " + _each(
        "i", "k % 4",
        f"struct(concat('G', (k + i) % 12), {_pick(('info', 'warning', 'error'), 'k + i')}, 'm', 100 - i)") + "))"),
    "validation": ("k % 9 <> 0", "struct(struct(NULL, NULL, struct(k * 37), struct(k * 37 + k % 2), " + _each(
        "i", "6L", f"""struct({_pick(CHECKS, 'i')}, (k + 7 * i + copy) % 40 > 0, (k + 11 * i) % 90 = 0, 'd', """ + _each(
            "j", "if((k + 7 * i + copy) % 40 = 0, (k + i) % 3 + 1, 0L)",
            f"""struct({_pick(CHECKS, 'i')}, concat('c', j), {_pick(CATEGORIES, 'i + j')},
                string(k + j), string(k - j), 'd')""") + ")")
        + """), struct('pandas', k % 17 <> 0, k % 50 / 8.0D + 0.25D), struct('spark', k % 19 <> 0, k % 400 / 2.0D + 1.0D),
             if(k % 4 = 0, struct(k % 20, k % 3, k % 2, k % 5), NULL))"""),
    "repair": ("k % 3 = 0", "struct(k % 4 = 3, k % 4 <> 3, " + _each(
        "i", "k % 5", f"""struct(i + 1, struct({_pick(CATEGORIES, 'k + i')}, concat('fix_', k * (i + 1) % 7)), string(NULL),
            (k + i) % 6 <> 0, if((k + i) % 6 = 0, 'repeated', NULL), if((k + 2 * i) % 4 = 0, 'PASS', 'FAIL'),
            if((k + i) % 5 <> 0, k * (i + 3) % 7, NULL))""") + ")"),
    "optimization": ("k % 2 = 1", "struct(k % 6 = 1, " + _each(
        "i", "k % 4", f"""struct(i + 1, struct({_pick(APPROACHES, 'k + i')}, 1.0D + (k + i) % 9 / 8.0D), (k + i) % 8 <> 0,
            CASE WHEN (k + i) % 16 = 0 THEN 'no grounded opportunity' WHEN (k + i) % 8 = 0 THEN 'measured before' END,
            CASE WHEN (k + i) % 9 = 0 THEN NULL WHEN (k + i) % 7 = 0 THEN 'FAIL' ELSE 'PASS' END,
            (k + i) % 3 = 0 AND (k + i) % 8 <> 0,
            if((k + i) % 11 <> 0, struct(1.10D, 0.25D,
               {_bench('k + i', '(k + i) % 7 + 1', '4.0D + k % 4', '(k + i) % 23 = 0')},
               {_bench('k + 2 * i', '(k + 2 * i) % 7 + 1', '2.0D + (k + i) % 6', '(k + i) % 29 = 0')}), NULL))""")
        + f", {_bench('k', '4L', '8.0D', 'false')}, {_bench('k + 1', '5L', '4.0D + k % 4', 'false')})"),
    "delivery": ("k % 12 <> 0", f"struct(if(k % 10 <> 0, struct({_pick(('ready', 'draft', 'refused'), 'k')}), NULL), "
        "struct(k % 6, " + _each("i", "k % 3", "struct('rows', string(k + i))") + "))"),
    "stages": ("true", _each(
        "i", "k % 8", f"""struct({_pick(STAGES, 'i')}, timestamp_micros(unix_micros(d) + i * 1000000000),
            if(i < k % 8 - 1 OR k % 3 <> 0,
               timestamp_micros(unix_micros(d) + i * 1000000000 + k * (i + 1) % 2000 * 125000), NULL),
            if(i < k % 8 - 1 OR k % 3 <> 0, (k + i) % 5 <> 0, NULL), 1)""")),
}


def _built(spark: SparkSession, sf: str, copies: str, parts: Sequence[str]) -> DataFrame:
    """Records with the named nested parts; the others are null.

    The parts come out of one ``inline``, which computes each of them once. As plain projected
    expressions the optimizer would copy a part into every access to one of its fields.
    """
    orders = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS k", "CAST(o_orderdate AS TIMESTAMP) AS d", f"explode({copies}) AS copy"
    )
    types = {f.name: f.dataType.simpleString() for f in record_schema().fields}
    wanted = {name: FIELDS[name] for name in parts}
    built = ", ".join(
        f"CAST(if({present}, {text}, NULL) AS {types[name]}) AS {name}" for name, (present, text) in wanted.items()
    )
    rows = orders.selectExpr("k", "d", "copy", f"inline(array(struct({built})))")
    return rows.selectExpr(
        "concat('m', k) AS migration_id",
        "concat('jobs/', k % 100, '.py') AS source_path",
        "d AS created_at",
        "'optimization' AS stage",
        "(k + copy) % 11 = 0 AS failed",
        "if((k + copy) % 11 = 0, 'timed out', NULL) AS failure_reason",
        *[name if name in wanted else f"CAST(NULL AS {types[name]}) AS {name}" for name in FIELDS],
        "d - make_dt_interval(copy) AS modified_at",
    )


def records(spark: SparkSession, sf: str, *parts: str) -> DataFrame:
    """The corpus as nested records, newest copies and older ones, with the named parts (or all)."""
    return _built(spark, sf, "if(o_orderkey % 5 = 0, array(0, 1), array(0))", parts or tuple(FIELDS))


def newest(spark: SparkSession, sf: str, *parts: str) -> DataFrame:
    """The corpus without the older copies, as it is after deduplication."""
    return _built(spark, sf, "array(0)", parts or tuple(FIELDS))


# --- the same facts in SQL ---------------------------------------------------------------------------

R = """
r AS (SELECT o_orderkey AS k, 'm' || o_orderkey AS id, o_orderdate AS d, o_orderkey % 11 = 0 AS failed,
             o_orderkey % 7 <> 0 AS has_plan, o_orderkey % 13 <> 0 AS has_code, o_orderkey % 9 <> 0 AS has_val,
             o_orderkey % 3 = 0 AS has_repair, o_orderkey % 2 = 1 AS has_opt, o_orderkey % 12 <> 0 AS has_del,
             (['low', 'medium', 'high'])[(o_orderkey % 3)::INT + 1] AS planned
      FROM orders)
"""

CHECKS_SQL = f"""
ck AS (SELECT k, id, i, {_sql_pick(CHECKS, "i")} AS name, (k + 7 * i) % 40 > 0 AS passed,
              (k + 11 * i) % 90 = 0 AS skipped, CASE WHEN (k + 7 * i) % 40 = 0 THEN (k + i) % 3 + 1 ELSE 0 END AS nd
       FROM r, range(6) t(i) WHERE has_val),
st AS (SELECT k, id, CASE WHEN bool_or(skipped) THEN 'ERROR' WHEN bool_and(passed) THEN 'PASS' ELSE 'FAIL' END AS status,
              count(*) AS n, count(*) FILTER (passed) AS n_passed, count(*) FILTER (NOT passed) AS n_failed,
              sum(nd) AS nd
       FROM ck GROUP BY k, id)
"""

DECLARED_SQL = f"""
pd AS (SELECT k, id, s, i, {_sql_pick(CATEGORIES, "k + s + i")} AS category,
              {_sql_pick((*CHECKS, "column_statistics", "lineage"), "k + s + 3 * i")} AS wanted
       FROM r, range(2) a(s), range(2) b(i) WHERE has_plan AND s < k % 3 AND i < (k + s) % 3)
"""

REPAIRS_SQL = f"""
rp AS (SELECT k, id, i + 1 AS attempt, {_sql_pick(CATEGORIES, "k + i")} AS category,
              'fix_' || ((k * (i + 1)) % 7) AS approach, (k + i) % 6 <> 0 AS admitted,
              (k + 2 * i) % 4 = 0 AS succeeded, CASE WHEN (k + i) % 5 <> 0 THEN (k * (i + 3)) % 7 END AS differences
       FROM r, range(4) t(i) WHERE has_repair AND i < k % 5)
"""

STAGES_SQL = f"""
sg AS (SELECT k, id, i, {_sql_pick(STAGES, "i")} AS stage,
              CASE WHEN i < k % 8 - 1 OR k % 3 <> 0 THEN ((k * (i + 1)) % 2000) * 0.125::DOUBLE END AS seconds,
              CASE WHEN i < k % 8 - 1 OR k % 3 <> 0 THEN (k + i) % 5 <> 0 END AS succeeded
       FROM r, range(7) t(i) WHERE i < k % 8)
"""

# list-valued statistics of short duration lists, stated from their definitions
_MEDIAN = "list_median({x})"
TRIES_SQL = f"""
tr0 AS (SELECT k, id, i, k + i AS e, i + 1 AS attempt, {_sql_pick(APPROACHES, "k + i")} AS approach,
               1.0 + ((k + i) % 9) / 8.0 AS predicted, (k + i) % 8 <> 0 AS admitted,
               CASE WHEN (k + i) % 9 <> 0 THEN CASE WHEN (k + i) % 7 = 0 THEN 'FAIL' ELSE 'PASS' END END AS status,
               (k + i) % 3 = 0 AND (k + i) % 8 <> 0 AS accepted, (k + i) % 11 <> 0 AS measured,
               (k + i) % 23 = 0 AS b_failed, (k + i) % 29 = 0 AS c_failed
        FROM r, range(3) t(i) WHERE has_opt AND i < k % 4),
bd AS (SELECT k, i, 'b' AS side, 4.0 + (k % 4) + (((k + i) * (q + 3)) % 16) / 16.0 AS v
       FROM tr0, range(7) u(q) WHERE measured AND q < (k + i) % 7 + 1
       UNION ALL
       SELECT k, i, 'c', 2.0 + ((k + i) % 6) + (((k + 2 * i) * (q + 3)) % 16) / 16.0
       FROM tr0, range(7) u(q) WHERE measured AND q < (k + 2 * i) % 7 + 1),
bm AS (SELECT *, median(v) OVER (PARTITION BY k, i, side) AS m,
              row_number() OVER (PARTITION BY k, i, side ORDER BY v) - 1 AS rn,
              count(*) OVER (PARTITION BY k, i, side) AS n FROM bd),
bs AS (SELECT k, i, side, any_value(m)::DOUBLE AS med, any_value(n) AS n,
              max(CASE WHEN rn = round_even(0.75 * (n - 1), 0) THEN v END)::DOUBLE AS p75,
              CASE WHEN any_value(n) < 2 THEN 0.0 ELSE 1.4826 * median(abs(v - m)) / any_value(m) END AS noise
       FROM bm GROUP BY k, i, side),
tr AS (SELECT t.*, b.med AS b_med, c.med AS c_med, b.med / c.med AS speedup, b.n AS b_n, c.n AS c_n,
              b.noise AS b_noise, c.noise AS c_noise,
              b_failed OR c_failed OR b.n < 2 OR c.n < 2 OR greatest(b.noise, c.noise) > 0.25 AS inconclusive,
              c.p75 < b.med AS robust
       FROM tr0 t LEFT JOIN bs b ON b.k = t.k AND b.i = t.i AND b.side = 'b'
                  LEFT JOIN bs c ON c.k = t.k AND c.i = t.i AND c.side = 'c')
"""

OUTCOME_SQL = """
ob AS (SELECT k, 'b' AS side, 8.0 + ((k * (q + 3)) % 16) / 16.0 AS v FROM r, range(4) u(q) WHERE has_opt
       UNION ALL
       SELECT k, 'f', 4.0 + (k % 4) + (((k + 1) * (q + 3)) % 16) / 16.0 FROM r, range(5) u(q) WHERE has_opt),
om AS (SELECT k, median(v) FILTER (side = 'b')::DOUBLE AS b, median(v) FILTER (side = 'f')::DOUBLE AS f
       FROM ob GROUP BY k),
oc AS (SELECT k, CASE WHEN k % 6 = 1 THEN b / f ELSE 1.0 END AS speedup, k % 6 = 1 AS applied FROM om)
"""
