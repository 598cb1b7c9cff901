"""Profiles of the driver tables, and the file readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parity.operators import profile
from parity.plans.catalog import query, table
from parity.plans.frame_queries import holed
from parity.session import scratch_path
from parity.sources import datasets, files


def _profiled(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        "o_orderkey",
        holed("o_custkey", "o_orderkey", 11).alias("c"),
        holed("o_orderstatus", "o_orderkey", 13).alias("s"),
    )


@query(
    "profile_columns",
    """
WITH h AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END AS c,
                  CASE WHEN o_orderkey % 13 <> 0 THEN o_orderstatus END AS s FROM orders),
l AS (SELECT 'o_orderkey' AS "column", 0 AS ordinal, 'bigint' AS dtype, o_orderkey::VARCHAR AS v, o_orderkey AS n FROM h
      UNION ALL SELECT 'c', 1, 'bigint', c::VARCHAR, c FROM h UNION ALL SELECT 's', 2, 'string', s, NULL FROM h),
e AS (SELECT "column", string_agg(v, ',' ORDER BY v) AS ex FROM (SELECT DISTINCT "column", v FROM l WHERE v IS NOT NULL
      QUALIFY dense_rank() OVER (PARTITION BY "column" ORDER BY v) <= 3) GROUP BY 1)
SELECT "column", ordinal, dtype, count(*) FILTER (v IS NULL)::BIGINT AS null_count,
       round(count(*) FILTER (v IS NULL) / count(*), 9) AS null_fraction, count(DISTINCT v)::BIGINT AS distinct_count,
       CASE WHEN dtype = 'string' THEN min(v) ELSE min(n)::VARCHAR END AS min_value,
       CASE WHEN dtype = 'string' THEN max(v) ELSE max(n)::VARCHAR END AS max_value, any_value(ex) AS examples
FROM l JOIN e USING ("column") GROUP BY "column", ordinal, dtype
""",
)
def profile_columns(spark: SparkSession, sf: str) -> DataFrame:
    found = profile.profile_columns(_profiled(spark, sf))
    return found.withColumns(
        {"examples": F.array_join("examples", ","), "null_fraction": F.round("null_fraction", 9)}
    )


@query(
    "profile_dataset",
    """
SELECT 'lineitem.parquet' AS name, 'parquet' AS format, TRUE AS "exists", count(*)::BIGINT AS row_count,
       FALSE AS sampled, 11 AS column_count FROM lineitem
""",
)
def profile_dataset(spark: SparkSession, sf: str) -> DataFrame:
    found = profile.profile_dataset(spark, f"{sf}/lineitem.parquet")
    name = F.regexp_extract("path", r"([^/]+)$", 1).alias("name")
    return found.select(name, "format", "exists", "row_count", "sampled", "column_count")


def _written(spark: SparkSession, sf: str) -> str:
    """A directory with a dataset in each format."""
    path = scratch_path(spark, "directory")
    files.to_parquet(table(spark, sf, "nation").select("n_nationkey", "n_name"), f"{path}/nations.parquet")
    files.to_csv(table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), f"{path}/suppliers.csv")
    files.to_json(table(spark, sf, "region").select("r_regionkey"), f"{path}/regions.json")
    return path


def _name():
    return F.regexp_extract("path", r"([^/]+)$", 1).alias("name")


@query(
    "broadcast_candidates",
    """
SELECT 'nations.parquet' AS name, count(*)::BIGINT AS row_count, true AS broadcast_candidate FROM nation
UNION ALL SELECT 'suppliers.csv', count(*)::BIGINT, true FROM supplier
UNION ALL SELECT 'regions.json', count(*)::BIGINT, true FROM region
""",
)
def broadcast_candidates(spark: SparkSession, sf: str) -> DataFrame:
    report = profile.size_report(profile.profile_directory(spark, _written(spark, sf)))
    return report.select(_name(), "row_count", "broadcast_candidate")


#: Copies of the order texts that make an export larger than what may be broadcast, whatever the scale.
_WIDE_BYTES = 64 << 20


@query(
    "broadcast_flags",
    """
SELECT 'nations.parquet' AS name, count(*)::BIGINT AS row_count, true AS broadcast_candidate FROM nation
UNION ALL SELECT 'orders.csv', count(*)::BIGINT, false FROM orders
""",
)
def broadcast_flags(spark: SparkSession, sf: str) -> DataFrame:
    """A small dataset may be broadcast; every order with a wide text beside it is too large for that."""
    path = scratch_path(spark, "flags")
    files.to_parquet(table(spark, sf, "nation"), f"{path}/nations.parquet")
    orders = table(spark, sf, "orders")
    wide = F.repeat(F.lit("wide "), F.lit(-(-_WIDE_BYTES // (5 * max(orders.count(), 1))) + 1))
    files.to_csv(orders.select("o_orderkey", "o_orderstatus", wide.alias("note")), f"{path}/orders.csv")
    report = profile.size_report(profile.profile_directory(spark, path))
    return report.select(_name(), "row_count", "broadcast_candidate")


@query(
    "profile_directory",
    """
SELECT 'nations.parquet' AS name, 'parquet' AS format, count(*)::BIGINT AS row_count, 2 AS column_count FROM nation
UNION ALL SELECT 'suppliers.csv', 'csv', count(*)::BIGINT, 2 FROM supplier
UNION ALL SELECT 'regions.json', 'json', count(*)::BIGINT, 1 FROM region
""",
)
def profile_directory(spark: SparkSession, sf: str) -> DataFrame:
    found = profile.profile_directory(spark, _written(spark, sf))
    return found.select(_name(), "format", "row_count", "column_count")


@query(
    "profile_directory_columns",
    """
SELECT 'nations.parquet' AS name, 'n_nationkey' AS "column", count(DISTINCT n_nationkey)::BIGINT AS distinct_count FROM nation
UNION ALL SELECT 'nations.parquet', 'n_name', count(DISTINCT n_name)::BIGINT FROM nation
UNION ALL SELECT 'suppliers.csv', 's_suppkey', count(DISTINCT s_suppkey)::BIGINT FROM supplier
UNION ALL SELECT 'suppliers.csv', 's_acctbal', count(DISTINCT s_acctbal)::BIGINT FROM supplier
UNION ALL SELECT 'regions.json', 'r_regionkey', count(DISTINCT r_regionkey)::BIGINT FROM region
""",
)
def profile_directory_columns(spark: SparkSession, sf: str) -> DataFrame:
    found = profile.profile_directory_columns(spark, _written(spark, sf))
    return found.select(_name(), "column", "distinct_count")


#: The tables of a given directory and their columns.
_GIVEN = {
    "benchmark": "item_id text",
    "conversations": "conv_id turn role text",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label",
    "events": "event_id ts user_id event_type value props",
    "labels": "doc_id quality toxic",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "nation": "n_nationkey n_name n_regionkey",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "pages": "page_id url html",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "region": "r_regionkey r_name",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
}


@query(
    "profile_given_directory",
    " UNION ALL ".join(
        f"SELECT '{t}.parquet' AS name, 'parquet' AS format, count(*)::BIGINT AS row_count, {len(c.split())} AS column_count FROM {t}"
        for t, c in _GIVEN.items()
    ),
)
def profile_given_directory(spark: SparkSession, sf: str) -> DataFrame:
    """Every table of the directory itself."""
    return profile.profile_directory(spark, sf).select(_name(), "format", "row_count", "column_count")


@query(
    "profile_given_directory_columns",
    " UNION ALL ".join(
        f"""SELECT '{t}.parquet' AS name, '{c}' AS "column", {k} AS ordinal, count(*) FILTER ({c} IS NULL)::BIGINT AS null_count,
                   count(DISTINCT {c})::BIGINT AS distinct_count FROM {t}"""
        for t, columns in _GIVEN.items()
        for k, c in enumerate(columns.split())
    ),
)
def profile_given_directory_columns(spark: SparkSession, sf: str) -> DataFrame:
    found = profile.profile_directory_columns(spark, sf)
    return found.select(_name(), "column", "ordinal", "null_count", "distinct_count")


@query("given_broadcast_candidates")
def given_broadcast_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of files are not SQL; the tests hold the flags against the files."""
    return profile.size_report(profile.profile_directory(spark, sf))


@query(
    "profile_to_schema",
    """
WITH h AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END AS c,
                  CASE WHEN o_orderkey % 13 <> 0 THEN o_orderstatus END AS s FROM orders)
SELECT 'o_orderkey' AS "column", 0 AS ordinal, 'bigint' AS dtype, bool_or(o_orderkey IS NULL) AS nullable FROM h
UNION ALL SELECT 'c', 1, 'bigint', bool_or(c IS NULL) FROM h
UNION ALL SELECT 's', 2, 'string', bool_or(s IS NULL) FROM h
""",
)
def profile_to_schema(spark: SparkSession, sf: str) -> DataFrame:
    found = profile.schema_fields(profile.profile_columns(_profiled(spark, sf)))
    return found.select("column", "ordinal", "dtype", "nullable")


# --- readers and writers ------------------------------------------------------------------------------

_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"
_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(*_COLUMNS)


@query(
    "read_csv_pandas_types",
    """
SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_nationkey::DOUBLE END AS nation,
       CASE WHEN c_custkey % 33 <> 0 THEN c_mktsegment END AS segment, c_acctbal FROM customer
""",
)
def read_csv_pandas_types(spark: SparkSession, sf: str) -> DataFrame:
    """Missing values written the ways pandas knows; the integer column with holes comes back as double."""
    path = scratch_path(spark, "csv-types")
    texts = table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_custkey") % 7 == 0, "NA").otherwise(F.col("c_nationkey").cast("string")).alias("nation"),
        F.when(F.col("c_custkey") % 33 == 0, "None").otherwise(F.col("c_mktsegment")).alias("segment"),
        "c_acctbal",
    )
    files.to_csv(texts, path)
    return files.read_csv(spark, path)


@query("read_json_lines", "SELECT event_id, user_id, event_type, value FROM events")
def read_json_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "json-lines")
    files.to_json(table(spark, sf, "events").select("event_id", "user_id", "event_type", "value"), path)
    schema = "event_id bigint, user_id bigint, event_type string, value double"
    return files.read_json(spark, path, schema)


@query("write_csv_roundtrip", _ORDERS)
def write_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    orders = _orders(spark, sf)
    files.to_csv(orders, path)
    return files.read_csv(spark, path, orders.schema)


@query("write_parquet_roundtrip", _ORDERS)
def write_parquet_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "parquet")
    files.to_parquet(_orders(spark, sf), path)
    return files.read_parquet(spark, path)


@query("write_json_roundtrip", _ORDERS)
def write_json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "json")
    orders = _orders(spark, sf)
    files.to_json(orders, path)
    return files.read_json(spark, path, orders.schema)


@query("write_mode_append", f"{_ORDERS} UNION ALL {_ORDERS} WHERE o_orderkey % 2 = 0")
def write_mode_append(spark: SparkSession, sf: str) -> DataFrame:
    """An overwrite replaces what was there, an append adds to it."""
    path = scratch_path(spark, "append")
    orders = _orders(spark, sf)
    files.to_parquet(orders.filter(F.col("o_orderkey") % 3 == 0), path, "errorifexists")
    files.to_parquet(orders, path, "overwrite")
    files.to_parquet(orders.filter(F.col("o_orderkey") % 2 == 0), path, "append")
    return files.read_parquet(spark, path)


@query("load_part_files", _ORDERS)
def load_part_files(spark: SparkSession, sf: str) -> DataFrame:
    """A directory of part files with a marker file is one table."""
    path = scratch_path(spark, "parts")
    files.to_csv(_orders(spark, sf).repartition(4), path)
    return datasets.load_dataset(spark, path, _orders(spark, sf).schema)


@query("csv_text_roundtrip", "SELECT doc_id, ' ' || text || chr(10) || '\"x, y\" ' AS t FROM documents")
def csv_text_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with line breaks, quotes, separators and blanks at their ends come back as they were."""
    path = scratch_path(spark, "csv-text")
    texts = table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit(" "), F.col("text"), F.lit('\n"x, y" ')).alias("t")
    )
    files.to_csv(texts, path)
    return files.read_csv(spark, path)


@query("json_null_column_roundtrip", "SELECT n_nationkey, n_name, CAST(NULL AS VARCHAR) AS note FROM nation")
def json_null_column_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """A column without any value is still a column."""
    path = scratch_path(spark, "json-null")
    nations = table(spark, sf, "nation").select("n_nationkey", "n_name", F.lit(None).cast("string").alias("note"))
    files.to_json(nations, path)
    return files.read_json(spark, path)


@query(
    "load_parts_by_name",
    """
SELECT c_custkey AS k, c_acctbal AS bal, CASE WHEN c_custkey % 3 = 2 THEN c_mktsegment END AS segment
FROM customer
""",
)
def load_parts_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """CSV parts with their columns in another order, and a tab-separated part with one column more."""
    path = scratch_path(spark, "by-name")
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("segment")
    )
    third = F.pmod("k", F.lit(3))
    files.to_csv(rows.filter(third == 0).select("k", "bal"), f"{path}/a")
    files.to_csv(rows.filter(third == 1).select("bal", "k"), f"{path}/b")
    tabs = rows.filter(third == 2).select("segment", "bal", "k").coalesce(1)
    tabs.write.option("header", True).option("sep", "\t").option("extension", "tsv").csv(f"{path}/c")
    return datasets.load_dataset(spark, path)


@query(
    "load_parquet_parts_by_name",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice END AS o_totalprice FROM orders",
)
def load_parquet_parts_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """A column that only later parts have."""
    path = scratch_path(spark, "parquet-by-name")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    files.to_parquet(orders.filter(F.col("o_orderkey") % 2 == 0).select("o_orderkey"), f"{path}/a")
    files.to_parquet(orders.filter(F.col("o_orderkey") % 2 == 1), f"{path}/b")
    return datasets.load_dataset(spark, path)
