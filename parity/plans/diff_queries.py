"""Dataset comparison over the driver tables: the orders against a candidate with known faults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parity.operators import compare, stats
from parity.plans.catalog import query, table
from parity.plans.frame_queries import CUSTOMERS, holed, revenue_by_nation

def reference(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def candidate(spark: SparkSession, sf: str) -> DataFrame:
    """Lost rows (97), new rows (109), changed prices (101), noise (7), lost values (103)."""
    k = F.col("o_orderkey")
    kept = reference(spark, sf).filter(k % 97 != 0)
    added = kept.filter(k % 109 == 0).withColumn("o_orderkey", k + 1_000_000_000)
    price = (
        F.when(k % 101 == 0, F.col("o_totalprice") + 1.0)
        .when(k % 7 == 0, F.col("o_totalprice") * (1 + 1e-13))
        .otherwise(F.col("o_totalprice"))
    )
    return kept.unionByName(added).select(
        "o_orderkey",
        "o_custkey",
        holed("o_orderstatus", "o_orderkey", 103).alias("o_orderstatus"),
        price.alias("o_totalprice"),
    )


SIDES = """
a AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders),
b0 AS (SELECT * FROM a WHERE o_orderkey % 97 <> 0
       UNION ALL SELECT o_orderkey + 1000000000, o_custkey, o_orderstatus, o_totalprice FROM a
       WHERE o_orderkey % 97 <> 0 AND o_orderkey % 109 = 0),
b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 103 <> 0 THEN o_orderstatus END AS o_orderstatus,
             CASE WHEN o_orderkey % 101 = 0 THEN o_totalprice + 1.0
                  WHEN o_orderkey % 7 = 0 THEN o_totalprice * (1 + 1e-13::DOUBLE) ELSE o_totalprice END AS o_totalprice
      FROM b0)
"""


@query(
    "diff_schema",
    f"""
WITH {SIDES}
SELECT * FROM (VALUES
  ('schema', 'o_orderstatus', NULL, 'present', 'absent'),
  ('schema', 'index', 'index_semantics', 'absent', 'present'),
  ('schema', 'o_orderkey', 'type_coercion', 'bigint (integer)', 'double (float)'))
  t("check", "column", category, reference, candidate)
UNION ALL
SELECT 'row_count', NULL, 'null_semantics', x.n::VARCHAR, y.n::VARCHAR
FROM (SELECT count(*) AS n FROM a) x, (SELECT count(*) AS n FROM b) y WHERE x.n <> y.n
""",
)
def diff_schema(spark: SparkSession, sf: str) -> DataFrame:
    """Schema faults, reported beside the row counts of the same two frames."""
    changed = candidate(spark, sf).drop("o_orderstatus").withColumns(
        {"o_orderkey": F.col("o_orderkey").cast("double"), "index": F.col("o_orderkey")}
    )
    result = compare.compare(reference(spark, sf), changed, checks=["schema", "row_count"])
    return result.differences.drop("detail")


@query(
    "column_stats",
    """
WITH h AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END AS c,
                  CASE WHEN o_orderkey % 13 <> 0 THEN o_orderstatus END AS s,
                  CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice END AS p FROM orders)
SELECT 'o_orderkey' AS "column", 'bigint' AS dtype, count(*) FILTER (o_orderkey IS NULL)::BIGINT AS null_count,
       count(DISTINCT o_orderkey)::BIGINT AS distinct_count, sum(o_orderkey)::DOUBLE AS numeric_sum,
       min(o_orderkey)::DOUBLE AS numeric_min, max(o_orderkey)::DOUBLE AS numeric_max FROM h
UNION ALL SELECT 'c', 'bigint', count(*) FILTER (c IS NULL), count(DISTINCT c), sum(c), min(c), max(c) FROM h
UNION ALL SELECT 's', 'string', count(*) FILTER (s IS NULL), count(DISTINCT s), NULL, NULL, NULL FROM h
UNION ALL SELECT 'p', 'double', count(*) FILTER (p IS NULL), count(DISTINCT p), round(sum(p), 2), min(p), max(p) FROM h
""",
)
def column_stats(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        holed("o_custkey", "o_orderkey", 11).alias("c"),
        holed("o_orderstatus", "o_orderkey", 13).alias("s"),
        holed("o_totalprice", "o_orderkey", 17).alias("p"),
    )
    return stats.column_stats(orders).withColumn("numeric_sum", F.round("numeric_sum", 2))


@query(
    "dataset_stats",
    """
WITH l AS (SELECT l_suppkey, l_returnflag, l_linestatus, CASE WHEN l_orderkey % 5 <> 0 THEN l_quantity END AS q FROM lineitem)
SELECT (SELECT count(*) FROM l)::BIGINT AS row_count,
       (SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM l GROUP BY l_suppkey, l_returnflag, l_linestatus, q))::BIGINT AS duplicate_row_count,
       (SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM l GROUP BY l_suppkey, l_returnflag))::BIGINT AS duplicate_key_count
""",
)
def dataset_stats(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(
        "l_suppkey", "l_returnflag", "l_linestatus", holed("l_quantity", "l_orderkey", 5).alias("q")
    )
    return stats.dataset_stats(lines, ["l_suppkey", "l_returnflag"])


def _differences(spark: SparkSession, sf: str, check: str) -> DataFrame:
    return compare.compare(
        reference(spark, sf), candidate(spark, sf), ["o_orderkey"], checks=[check], portable_checksum=True
    ).differences


@query(
    "diff_row_count",
    f"""
WITH {SIDES}, n AS (SELECT (SELECT count(*) FROM a) AS x, (SELECT count(*) FROM b) AS y)
SELECT 'row_count' AS "check", NULL::VARCHAR AS "column", 'null_semantics' AS category, x::VARCHAR AS reference,
       y::VARCHAR AS candidate, 'row counts differ by ' || CASE WHEN y > x THEN '+' ELSE '' END || (y - x) AS detail
FROM n WHERE x <> y
""",
)
def diff_row_count(spark: SparkSession, sf: str) -> DataFrame:
    return _differences(spark, sf, "row_count")


@query(
    "diff_null_counts",
    f"""
WITH {SIDES},
n AS (SELECT 'o_orderkey' AS c, (SELECT count(*) - count(o_orderkey) FROM a) AS x, (SELECT count(*) - count(o_orderkey) FROM b) AS y
      UNION ALL SELECT 'o_custkey', (SELECT count(*) - count(o_custkey) FROM a), (SELECT count(*) - count(o_custkey) FROM b)
      UNION ALL SELECT 'o_orderstatus', (SELECT count(*) - count(o_orderstatus) FROM a), (SELECT count(*) - count(o_orderstatus) FROM b)
      UNION ALL SELECT 'o_totalprice', (SELECT count(*) - count(o_totalprice) FROM a), (SELECT count(*) - count(o_totalprice) FROM b))
SELECT c AS "column", 'null_semantics' AS category, x::VARCHAR AS reference, y::VARCHAR AS candidate FROM n WHERE x <> y
""",
)
def diff_null_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _differences(spark, sf, "null_counts").drop("check", "detail")


@query(
    "diff_duplicate_counts",
    """
WITH a AS (SELECT l_suppkey, l_returnflag, l_quantity FROM lineitem),
b AS (SELECT * FROM a UNION ALL SELECT l_suppkey, l_returnflag, l_quantity FROM lineitem WHERE l_orderkey % 10 = 0)
SELECT NULL::VARCHAR AS "column", (SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM a GROUP BY ALL l_suppkey, l_returnflag, l_quantity))::VARCHAR AS reference,
       (SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM b GROUP BY l_suppkey, l_returnflag, l_quantity))::VARCHAR AS candidate
UNION ALL
SELECT 'l_suppkey,l_returnflag', (SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM a GROUP BY l_suppkey, l_returnflag))::VARCHAR,
       (SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM b GROUP BY l_suppkey, l_returnflag))::VARCHAR
""".replace("GROUP BY ALL l_suppkey", "GROUP BY l_suppkey"),
)
def diff_duplicate_counts(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    columns = ["l_suppkey", "l_returnflag", "l_quantity"]
    a = lines.select(*columns)
    b = a.unionByName(lines.filter(F.col("l_orderkey") % 10 == 0).select(*columns))
    found = compare.duplicate_differences(a, b, ["l_suppkey", "l_returnflag"])
    return found.select("column", "reference", "candidate")


@query(
    "diff_checksums",
    f"""
WITH {SIDES},
n AS (SELECT 'o_orderkey' AS c, (SELECT sum(o_orderkey)::DOUBLE FROM a) AS x, (SELECT sum(o_orderkey)::DOUBLE FROM b) AS y
      UNION ALL SELECT 'o_custkey', (SELECT sum(o_custkey)::DOUBLE FROM a), (SELECT sum(o_custkey)::DOUBLE FROM b)
      UNION ALL SELECT 'o_totalprice', (SELECT sum(o_totalprice) FROM a), (SELECT sum(o_totalprice) FROM b))
SELECT c AS "column", 'floating_point' AS category, round(x, 2) AS reference, round(y, 2) AS candidate FROM n
WHERE abs(x - y) / greatest(abs(x), abs(y), 1e-12) > 1e-9
""",
)
def diff_checksums(spark: SparkSession, sf: str) -> DataFrame:
    found = _differences(spark, sf, "aggregate_checksums").filter("category is not null")
    return found.select(
        "column",
        "category",
        F.round(F.col("reference").cast("double"), 2).alias("reference"),
        F.round(F.col("candidate").cast("double"), 2).alias("candidate"),
    )


@query(
    "diff_value_hash",
    f"""
WITH {SIDES},
h AS (SELECT (SELECT sum(('0x' || substr(md5(o_orderstatus), 1, 15))::BIGINT::HUGEINT) FROM a) AS x,
             (SELECT sum(('0x' || substr(md5(o_orderstatus), 1, 15))::BIGINT::HUGEINT) FROM b) AS y)
SELECT 'o_orderstatus' AS "column", x::VARCHAR AS reference, y::VARCHAR AS candidate FROM h WHERE x <> y
""",
)
def diff_value_hash(spark: SparkSession, sf: str) -> DataFrame:
    found = _differences(spark, sf, "aggregate_checksums").filter("category is null")
    return found.select("column", "reference", "candidate")


@query(
    "diff_column_stats",
    f"""
WITH {SIDES},
n AS (SELECT 'o_orderkey' AS c, 'min' AS l, (SELECT min(o_orderkey)::DOUBLE FROM a) AS x, (SELECT min(o_orderkey)::DOUBLE FROM b) AS y
      UNION ALL SELECT 'o_orderkey', 'max', (SELECT max(o_orderkey) FROM a), (SELECT max(o_orderkey) FROM b)
      UNION ALL SELECT 'o_orderkey', 'mean', (SELECT avg(o_orderkey) FROM a), (SELECT avg(o_orderkey) FROM b)
      UNION ALL SELECT 'o_custkey', 'min', (SELECT min(o_custkey) FROM a), (SELECT min(o_custkey) FROM b)
      UNION ALL SELECT 'o_custkey', 'max', (SELECT max(o_custkey) FROM a), (SELECT max(o_custkey) FROM b)
      UNION ALL SELECT 'o_custkey', 'mean', (SELECT avg(o_custkey) FROM a), (SELECT avg(o_custkey) FROM b)
      UNION ALL SELECT 'o_totalprice', 'min', (SELECT min(o_totalprice) FROM a), (SELECT min(o_totalprice) FROM b)
      UNION ALL SELECT 'o_totalprice', 'max', (SELECT max(o_totalprice) FROM a), (SELECT max(o_totalprice) FROM b)
      UNION ALL SELECT 'o_totalprice', 'mean', (SELECT avg(o_totalprice) FROM a), (SELECT avg(o_totalprice) FROM b)
      UNION ALL SELECT 'o_orderstatus', 'distinct', (SELECT count(DISTINCT o_orderstatus) FROM a), (SELECT count(DISTINCT o_orderstatus) FROM b))
SELECT c AS "column", l AS statistic FROM n
WHERE CASE WHEN l = 'distinct' THEN x <> y ELSE x <> y AND abs(x - y) / greatest(abs(x), abs(y), 1e-12) > 1e-9 END
""",
)
def diff_column_stats(spark: SparkSession, sf: str) -> DataFrame:
    found = _differences(spark, sf, "column_statistics")
    statistic = F.when(F.col("category").isNull(), "distinct").otherwise(F.split("reference", "=")[0])
    return found.select("column", statistic.alias("statistic"))


CELLS = f"""
{SIDES},
j AS (SELECT a.o_orderkey AS ak, b.o_orderkey AS bk, a.o_custkey AS ac, b.o_custkey AS bc, a.o_orderstatus AS asx,
             b.o_orderstatus AS bsx, a.o_totalprice AS ap, b.o_totalprice AS bp
      FROM a FULL JOIN b ON a.o_orderkey IS NOT DISTINCT FROM b.o_orderkey),
cells AS (SELECT 'left_only' AS kind, NULL::VARCHAR AS col, -1 AS ordinal, ak AS k FROM j WHERE bk IS NULL
      UNION ALL SELECT 'right_only', NULL, -1, bk FROM j WHERE ak IS NULL
      UNION ALL SELECT 'cell', 'o_custkey', 0, ak FROM j WHERE ak = bk AND ac IS DISTINCT FROM bc
      UNION ALL SELECT 'cell', 'o_orderstatus', 1, ak FROM j WHERE ak = bk AND asx IS DISTINCT FROM bsx
      UNION ALL SELECT 'cell', 'o_totalprice', 2, ak FROM j WHERE ak = bk AND ap <> bp
                AND abs(ap - bp) / greatest(abs(ap), abs(bp), 1e-12) > 1e-9)
"""


@query(
    "diff_keyed_cells",
    f"""WITH {CELLS} SELECT kind, 'o_orderkey=' || k AS key, col AS "column", ordinal::INT AS ordinal FROM cells""",
)
def diff_keyed_cells(spark: SparkSession, sf: str) -> DataFrame:
    cells = compare.keyed_cells(reference(spark, sf), candidate(spark, sf), ["o_orderkey"])
    return cells.select("kind", "key", "column", "ordinal")


@query(
    "diff_keyed_summary",
    f"""WITH {CELLS} SELECT kind, col AS "column", count(*)::BIGINT AS mismatches FROM cells GROUP BY kind, col""",
)
def diff_keyed_summary(spark: SparkSession, sf: str) -> DataFrame:
    return compare.keyed_summary(
        compare.keyed_cells(reference(spark, sf), candidate(spark, sf), ["o_orderkey"])
    )


@query(
    "diff_samples",
    f"""
WITH {CELLS}, n AS (SELECT kind, col, count(*) AS n FROM cells GROUP BY kind, col)
SELECT c.kind, 'o_orderkey=' || k AS key, c.col AS "column"
FROM cells c
QUALIFY row_number() OVER (PARTITION BY c.kind, c.col ORDER BY 'o_orderkey=' || k) <= 10
""",
)
def diff_samples(spark: SparkSession, sf: str) -> DataFrame:
    cells = compare.keyed_cells(reference(spark, sf), candidate(spark, sf), ["o_orderkey"])
    return compare.samples(cells, ["kind", "column"], ["key"]).select("kind", "key", "column")


@query(
    "diff_sorted_fallback",
    """
WITH a AS (SELECT l_suppkey, l_linenumber, l_quantity, l_tax, row_number() OVER (
             ORDER BY l_suppkey NULLS LAST, l_linenumber NULLS LAST, l_quantity NULLS LAST, l_tax NULLS LAST) - 1 AS pos
           FROM (SELECT l_suppkey, l_linenumber, l_quantity, CASE WHEN l_partkey % 10 <> 0 THEN l_tax END AS l_tax FROM lineitem)),
b AS (SELECT l_suppkey, l_linenumber, l_quantity, l_tax, row_number() OVER (
             ORDER BY l_suppkey NULLS LAST, l_linenumber NULLS LAST, l_quantity NULLS LAST, l_tax NULLS LAST) - 1 AS pos
           FROM (SELECT l_suppkey, l_linenumber, CASE WHEN l_orderkey % 501 = 0 THEN l_quantity + 0.5 ELSE l_quantity END AS l_quantity,
                        CASE WHEN l_partkey % 10 <> 0 THEN l_tax END AS l_tax FROM lineitem)),
m AS (SELECT 'l_suppkey' AS col, a.pos FROM a JOIN b USING (pos) WHERE a.l_suppkey IS DISTINCT FROM b.l_suppkey
      UNION ALL SELECT 'l_linenumber', a.pos FROM a JOIN b USING (pos) WHERE a.l_linenumber IS DISTINCT FROM b.l_linenumber
      UNION ALL SELECT 'l_quantity', a.pos FROM a JOIN b USING (pos) WHERE a.l_quantity IS DISTINCT FROM b.l_quantity
      UNION ALL SELECT 'l_tax', a.pos FROM a JOIN b USING (pos) WHERE a.l_tax IS DISTINCT FROM b.l_tax)
SELECT col AS "column", count(*)::BIGINT AS mismatches, min(pos)::BIGINT AS first_position, max(pos)::BIGINT AS last_position
FROM m GROUP BY col
""",
)
def diff_sorted_fallback(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    tax = holed("l_tax", "l_partkey", 10).alias("l_tax")
    a = lines.select("l_suppkey", "l_linenumber", "l_quantity", tax)
    moved = F.when(F.col("l_orderkey") % 501 == 0, F.col("l_quantity") + 0.5).otherwise(F.col("l_quantity"))
    b = lines.select("l_suppkey", "l_linenumber", moved.alias("l_quantity"), tax)
    cells = compare.sorted_cells(a, b)
    return cells.groupBy("column").agg(
        F.sum("n").alias("mismatches"),
        F.min("pos").alias("first_position"),
        F.max(F.col("pos") + F.col("n") - 1).alias("last_position"),
    )


@query(
    "diff_verdict_error",
    """
SELECT 'ERROR' AS status, 3::BIGINT AS checks, 1::BIGINT AS failed, count(*)::BIGINT AS rows FROM orders
""",
)
def diff_verdict_error(spark: SparkSession, sf: str) -> DataFrame:
    """Declared keys that neither side has, and a check nobody knows: ERROR, though the data agree."""
    orders = reference(spark, sf)
    result = compare.compare(
        orders, orders, ["no_such_key"], checks=["row_count", "numeric_tolerance", "aggregate_checksums"]
    )
    rows = orders.agg(F.count(F.lit(1)).alias("rows"), F.lit("ERROR").alias("s"))
    return result.verdict.join(rows, F.col("status") == F.col("s")).drop("s")


@query(
    "compare_pass",
    """
SELECT 'PASS' AS status, 7::BIGINT AS checks, 0::BIGINT AS failed
""",
)
def compare_pass(spark: SparkSession, sf: str) -> DataFrame:
    """The orders against themselves in another order and with noise below the tolerance."""
    orders = table(spark, sf, "orders")
    noisy = orders.withColumn("o_totalprice", F.col("o_totalprice") * (1 + 1e-13)).repartition("o_custkey")
    return compare.compare(orders, noisy, ["o_orderkey"], checks=compare.KNOWN_CHECKS).verdict


@query(
    "compare_phantom_null_group",
    f"""
WITH {CUSTOMERS},
o AS (SELECT o_custkey, (o_orderkey % 5 + 1) * o_totalprice AS revenue FROM orders),
b AS (SELECT n_name, sum(revenue) AS revenue FROM cust LEFT JOIN o ON c_custkey = o_custkey WHERE bal >= 0 GROUP BY n_name),
a AS (SELECT n_name, coalesce(revenue, 0) AS revenue FROM b WHERE n_name IS NOT NULL)
SELECT 'row_count' AS "check", NULL::VARCHAR AS "column", 'null_semantics' AS category WHERE (SELECT count(*) FROM a) <> (SELECT count(*) FROM b)
UNION ALL SELECT 'null_counts', 'n_name', 'null_semantics' WHERE (SELECT count(*) FROM b WHERE n_name IS NULL) > 0
UNION ALL SELECT 'null_counts', 'revenue', 'null_semantics' WHERE (SELECT count(*) FROM b WHERE revenue IS NULL) > 0
UNION ALL SELECT 'numeric_tolerance', NULL, NULL FROM b WHERE n_name IS NULL
UNION ALL SELECT 'numeric_tolerance', 'revenue', 'floating_point' FROM b WHERE n_name IS NOT NULL AND revenue IS NULL
UNION ALL SELECT 'aggregate_checksums', 'n_name', NULL WHERE (SELECT count(*) FROM b WHERE n_name IS NULL) > 0
UNION ALL SELECT 'aggregate_checksums', 'revenue', 'floating_point'
          WHERE abs((SELECT sum(revenue) FROM a) - (SELECT sum(revenue) FROM b)) / (SELECT sum(revenue) FROM b) > 1e-9
""",
)
def compare_phantom_null_group(spark: SparkSession, sf: str) -> DataFrame:
    """The right translation against the naive one: an extra group of rows without a nation."""
    right = revenue_by_nation(spark, sf)
    naive = revenue_by_nation(spark, sf, dropna=False, zero=False)
    found = compare.compare(right, naive, ["n_name"], cache=True).differences
    return found.select("check", "column", "category")


@query(
    "diff_all_differences",
    f"""
WITH {CELLS}
SELECT kind, col AS "column", count(*)::BIGINT AS n FROM cells GROUP BY kind, col
""",
)
def diff_all_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Every difference of a whole comparison is there, not only the samples."""
    found = compare.compare(reference(spark, sf), candidate(spark, sf), ["o_orderkey"]).all_differences
    kind = (
        F.when(F.endswith("detail", F.lit("reference only")), "left_only")
        .when(F.endswith("detail", F.lit("candidate only")), "right_only")
        .otherwise("cell")
    )
    cells = found.filter(F.col("check") == "numeric_tolerance").select(kind.alias("kind"), "column")
    return cells.groupBy("kind", "column").agg(F.count(F.lit(1)).alias("n"))


@query(
    "compare_stats",
    f"""
WITH {SIDES}
SELECT 'reference' AS side, 'o_orderstatus' AS "column", count(*) - count(o_orderstatus) AS null_count,
       count(DISTINCT o_orderstatus) AS distinct_count FROM a
UNION ALL SELECT 'candidate', 'o_orderstatus', count(*) - count(o_orderstatus), count(DISTINCT o_orderstatus) FROM b
UNION ALL SELECT 'reference', 'o_custkey', count(*) - count(o_custkey), count(DISTINCT o_custkey) FROM a
UNION ALL SELECT 'candidate', 'o_custkey', count(*) - count(o_custkey), count(DISTINCT o_custkey) FROM b
""",
)
def compare_stats(spark: SparkSession, sf: str) -> DataFrame:
    """The report carries the statistics of both sides."""
    found = compare.compare(reference(spark, sf), candidate(spark, sf), ["o_orderkey"], checks=["schema"]).statistics
    wanted = found.filter(F.col("column").isin("o_orderstatus", "o_custkey"))
    return wanted.select("side", "column", F.col("null_count").cast("bigint"), F.col("distinct_count").cast("bigint"))


@query(
    "compare_paths_error",
    """
SELECT 'ERROR' AS status, true AS told, count(*)::BIGINT AS rows FROM orders
UNION ALL SELECT 'PASS', false, count(*)::BIGINT FROM orders
""",
)
def compare_paths_error(spark: SparkSession, sf: str) -> DataFrame:
    """Outputs by path: a missing one is an ERROR that says so, the same one twice a PASS."""
    path = f"{sf.rstrip('/')}/orders.parquet"
    missing = compare.compare_paths(spark, path, f"{sf.rstrip('/')}/no_such_output.parquet", keys=["o_orderkey"])
    same = compare.compare_paths(spark, path, path, keys=["o_orderkey"])
    n = table(spark, sf, "orders").agg(F.count(F.lit(1)).alias("rows"))
    told = missing.verdict.select("status", F.contains("error", F.lit("no_such_output")).alias("told"))
    return told.unionByName(same.verdict.select("status", F.lit(False).alias("told"))).crossJoin(F.broadcast(n))
