"""Frame, join, aggregation and window operators over the driver tables.

The tables hold no missing values, so each query makes some by a rule on the key, the same rule in
Spark and in SQL. The SQL states the pandas meaning directly and is not derived from the Spark side.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parity.functions.masks import and_, filter_rows, mask, ne, not_, or_, query as query_text
from parity.functions.numbers import round_half_even
from parity.operators import frame, groupby, joins, windows
from parity.plans.catalog import query, table


def holed(column: str, key: str, modulus: int) -> Column:
    """The column, missing on every row whose key divides by the modulus."""
    return F.when(F.col(key) % modulus != 0, F.col(column))


def gaps(column: str, key: str, modulus: int) -> Column:
    """The float column, missing on the same rows: by turns null and NaN, which SQL states as null both."""
    nan = F.lit(float("nan"))
    return F.when(F.col(key) % modulus != 0, F.col(column)).when(F.col(key) % (2 * modulus) == 0, nan)


def customers(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with their nation's name; both the name and the balance have holes."""
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    joined = joins.join(
        table(spark, sf, "customer"), nation, "inner", ["c_nationkey"], ["n_nationkey"]
    )
    return joined.select(
        "c_custkey",
        "c_mktsegment",
        holed("n_name", "c_custkey", 33).alias("n_name"),
        gaps("c_acctbal", "c_custkey", 7).alias("bal"),
    )


CUSTOMERS = """
cust AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 33 <> 0 THEN n_name END AS n_name,
                CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS bal
         FROM customer JOIN nation ON c_nationkey = n_nationkey)
"""


def priced_orders(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    quantity = (F.col("o_orderkey") % 5 + 1).cast("int")
    return frame.derive(orders, {"revenue": quantity * F.col("o_totalprice")})


def revenue_by_nation(spark: SparkSession, sf: str, dropna: bool = True, zero: bool = True) -> DataFrame:
    """Revenue per nation of customers in credit.

    Orders are summed per customer before the join: combined map-side, a customer with a third of
    all orders costs nothing, and the join has one row per customer on either side.
    """
    wealthy = filter_rows(customers(spark, sf), mask(F.col("bal") >= 0))
    orders = priced_orders(spark, sf)
    per_customer = groupby.groupby_agg(orders, ["o_custkey"], {"revenue": ("revenue", "sum")})
    both = joins.join(wealthy, per_customer, "left", ["c_custkey"], ["o_custkey"], max_group_rows=None)
    if zero:
        result = groupby.groupby_agg(both, ["n_name"], {"revenue": ("revenue", "sum")}, dropna=dropna)
    else:
        result = both.groupBy("n_name").agg(F.sum("revenue").alias("revenue"))
    return frame.sort_values(result, ["n_name"])


def cents(column: str) -> Column:
    """A price as a whole number, whose sums and means do not depend on the order of summation."""
    return F.round(F.col(column) * 100).cast("bigint")


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query(
    "flagship_revenue",
    f"""
WITH {CUSTOMERS}
SELECT n_name, round(coalesce(sum(revenue), 0.0), 2) AS revenue
FROM cust LEFT JOIN (SELECT o_custkey, (o_orderkey % 5 + 1) * o_totalprice AS revenue FROM orders)
     ON c_custkey = o_custkey
WHERE bal >= 0 AND n_name IS NOT NULL GROUP BY n_name ORDER BY n_name
""",
)
def flagship_revenue(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(revenue_by_nation(spark, sf), revenue=2)


@query(
    "flagship_naive",
    f"""
WITH {CUSTOMERS}
SELECT n_name, round(sum(revenue), 2) AS revenue
FROM cust LEFT JOIN (SELECT o_custkey, (o_orderkey % 5 + 1) * o_totalprice AS revenue FROM orders)
     ON c_custkey = o_custkey
WHERE bal >= 0 GROUP BY n_name
""",
)
def flagship_naive(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(revenue_by_nation(spark, sf, dropna=False, zero=False), revenue=2)


# --- filters, projections, derived columns -------------------------------------------------


@query("scan_parquet", "SELECT * FROM supplier")
def scan_parquet(spark: SparkSession, sf: str) -> DataFrame:
    from parity.sources.files import read_parquet

    return read_parquet(spark, f"{sf}/supplier.parquet")


@query(
    "filter_ge_nulls",
    f"WITH {CUSTOMERS} SELECT c_custkey, bal FROM cust WHERE bal IS NOT NULL AND bal >= 1000",
)
def filter_ge_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return filter_rows(customers(spark, sf), mask(F.col("bal") >= 1000)).select("c_custkey", "bal")


@query(
    "filter_ne_keeps_null",
    f"WITH {CUSTOMERS} SELECT c_custkey, n_name FROM cust WHERE n_name IS NULL OR n_name <> 'NATION_3'",
)
def filter_ne_keeps_null(spark: SparkSession, sf: str) -> DataFrame:
    return filter_rows(customers(spark, sf), ne(F.col("n_name"), "NATION_3")).select("c_custkey", "n_name")


@query(
    "filter_not_mask",
    f"""
WITH {CUSTOMERS}
SELECT c_custkey, bal, n_name FROM cust
WHERE (bal IS NULL OR NOT bal >= 1000)
   OR (n_name = 'NATION_1' AND c_mktsegment = 'BUILDING')
""",
)
def filter_not_mask(spark: SparkSession, sf: str) -> DataFrame:
    poor = not_(mask(F.col("bal") >= 1000))
    builders = and_(mask(F.col("n_name") == "NATION_1"), mask(F.col("c_mktsegment") == "BUILDING"))
    return filter_rows(customers(spark, sf), or_(poor, builders)).select("c_custkey", "bal", "n_name")


@query(
    "filter_query_string",
    """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_quantity > 45 AND l_discount BETWEEN 0.02 AND 0.04 AND l_returnflag <> 'N'
""",
)
def filter_query_string(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    text = "l_quantity > 45 and l_discount between 0.02 and 0.04 and not (l_returnflag <=> 'N')"
    return query_text(lines, text).select("l_orderkey", "l_linenumber", "l_quantity")


@query("project_drop", "SELECT p_partkey, p_brand, p_size, p_retailprice FROM part")
def project_drop(spark: SparkSession, sf: str) -> DataFrame:
    return frame.drop(table(spark, sf, "part"), ["p_name", "p_type"])


@query(
    "head_top_n",
    """
SELECT o_orderkey, o_totalprice FROM orders
ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25
""",
)
def head_top_n(spark: SparkSession, sf: str) -> DataFrame:
    orders = frame.select(table(spark, sf, "orders"), ["o_orderkey", "o_totalprice"])
    return frame.head(orders, 25, ["o_totalprice"], ascending=False, tiebreak=["o_orderkey"])


@query(
    "rename_columns",
    "SELECT s_suppkey AS supplier_id, s_name AS name, s_nationkey, s_acctbal FROM supplier",
)
def rename_columns(spark: SparkSession, sf: str) -> DataFrame:
    return frame.rename(table(spark, sf, "supplier"), {"s_suppkey": "supplier_id", "s_name": "name"})


@query(
    "derive_revenue",
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber * l_extendedprice AS weighted,
       CASE WHEN l_discount <> 0 THEN l_tax / l_discount END AS ratio
FROM lineitem
""",
)
def derive_revenue(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    derived = frame.derive(
        lines,
        {
            "weighted": F.col("l_linenumber") * F.col("l_extendedprice"),
            "ratio": frame.try_divide(F.col("l_tax"), F.col("l_discount")),
        },
    )
    return derived.select("l_orderkey", "l_linenumber", "l_partkey", "weighted", "ratio")


@query(
    "round_half_even",
    """
SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_quantity / 2, 0) AS half,
       round_even(l_quantity / 8, 2) AS eighth
FROM lineitem
""",
)
def round_half_even_query(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        round_half_even(F.col("l_quantity") / 2).alias("half"),
        round_half_even(F.col("l_quantity") / 8, 2).alias("eighth"),
    )


@query(
    "fillna_dict",
    f"""
WITH {CUSTOMERS}
SELECT c_custkey, coalesce(n_name, 'unknown') AS n_name, coalesce(bal, -1.0) AS bal FROM cust
""",
)
def fillna_dict(spark: SparkSession, sf: str) -> DataFrame:
    holes = customers(spark, sf).select("c_custkey", "n_name", "bal")
    return frame.fillna(holes, {"n_name": "unknown", "bal": -1})


@query(
    "dropna_subset",
    f"WITH {CUSTOMERS} SELECT c_custkey, n_name, bal FROM cust WHERE n_name IS NOT NULL",
)
def dropna_subset(spark: SparkSession, sf: str) -> DataFrame:
    return frame.dropna(customers(spark, sf).select("c_custkey", "n_name", "bal"), subset=["n_name"])


@query(
    "astype_int",
    "SELECT l_orderkey, l_linenumber, l_partkey, trunc(l_extendedprice)::BIGINT AS price FROM lineitem",
)
def astype_int(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("price")
    )
    return frame.astype(lines, {"price": "bigint"})


@query(
    "reset_index_noop",
    "SELECT o_orderstatus, count(*)::BIGINT AS n FROM orders GROUP BY o_orderstatus",
)
def reset_index_noop(spark: SparkSession, sf: str) -> DataFrame:
    counts = groupby.groupby_agg(
        table(spark, sf, "orders"), ["o_orderstatus"], {"n": ("o_orderkey", "count")}
    )
    return frame.reset_index(counts)


# --- joins -----------------------------------------------------------------------------------


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


def _segment(spark: SparkSession, sf: str, name: str) -> DataFrame:
    customer = table(spark, sf, "customer")
    return filter_rows(customer, mask(F.col("c_mktsegment") == name)).select("c_custkey", "c_name")


@query(
    "join_inner",
    """
SELECT o_orderkey, o_custkey, o_totalprice, c_custkey, c_name
FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'
""",
)
def join_inner(spark: SparkSession, sf: str) -> DataFrame:
    return joins.join(
        _orders(spark, sf), _segment(spark, sf, "BUILDING"), "inner", ["o_custkey"], ["c_custkey"]
    )


@query(
    "join_left",
    """
SELECT o_orderkey, o_custkey, o_totalprice, c_custkey, c_name
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey
""",
)
def join_left(spark: SparkSession, sf: str) -> DataFrame:
    return joins.join(
        _orders(spark, sf), _segment(spark, sf, "BUILDING"), "left", ["o_custkey"], ["c_custkey"]
    )


@query(
    "join_right",
    """
SELECT o_orderkey, o_custkey, o_totalprice, c_custkey, c_name
FROM (SELECT * FROM orders WHERE o_totalprice > 200000) RIGHT JOIN customer ON o_custkey = c_custkey
""",
)
def join_right(spark: SparkSession, sf: str) -> DataFrame:
    dear = filter_rows(_orders(spark, sf), mask(F.col("o_totalprice") > 200000))
    customer = table(spark, sf, "customer").select("c_custkey", "c_name")
    return joins.join(dear, customer, "right", ["o_custkey"], ["c_custkey"])


@query(
    "join_outer_indicator",
    """
WITH l AS (SELECT o_custkey AS k, count(*)::BIGINT AS n FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1),
     r AS (SELECT c_custkey AS k, c_acctbal AS n FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(l.k, r.k) AS k, l.n AS n_x, r.n AS n_y,
       CASE WHEN l.k IS NULL THEN 'right_only' WHEN r.k IS NULL THEN 'left_only' ELSE 'both' END AS _merge
FROM l FULL JOIN r ON l.k = r.k
""",
)
def join_outer_indicator(spark: SparkSession, sf: str) -> DataFrame:
    third = _orders(spark, sf).filter(F.col("o_orderkey") % 3 == 0)
    left = groupby.groupby_agg(third, ["o_custkey"], {"n": ("o_orderkey", "count")})
    right = table(spark, sf, "customer").filter(F.col("c_custkey") % 2 == 0)
    return joins.join(
        left.withColumnRenamed("o_custkey", "k"),
        right.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("n")),
        "outer",
        ["k"],
        indicator=True,
    )


@query("join_cross", "SELECT s_suppkey, s_acctbal, r_name FROM supplier CROSS JOIN region")
def join_cross(spark: SparkSession, sf: str) -> DataFrame:
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    return joins.join(suppliers, table(spark, sf, "region").select("r_name"), "cross")


@query(
    "join_semi",
    """
SELECT c_custkey, c_name FROM customer
WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)
""",
)
def join_semi(spark: SparkSession, sf: str) -> DataFrame:
    dear = filter_rows(_orders(spark, sf), mask(F.col("o_totalprice") > 300000))
    customer = table(spark, sf, "customer").select("c_custkey", "c_name")
    return joins.join(customer, dear, "semi", ["c_custkey"], ["o_custkey"])


@query(
    "join_anti",
    """
SELECT c_custkey, c_name FROM customer
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)
""",
)
def join_anti(spark: SparkSession, sf: str) -> DataFrame:
    dear = filter_rows(_orders(spark, sf), mask(F.col("o_totalprice") > 300000))
    customer = table(spark, sf, "customer").select("c_custkey", "c_name")
    return joins.join(customer, dear, "anti", ["c_custkey"], ["o_custkey"])


@query(
    "join_null_keys",
    """
WITH l AS (SELECT c_custkey, CASE WHEN c_custkey % 33 <> 0 THEN c_nationkey END AS nk FROM customer),
     r AS (SELECT CASE WHEN n_nationkey % 6 <> 0 THEN n_nationkey END AS nk, n_name FROM nation)
SELECT c_custkey, l.nk AS nk, n_name FROM l JOIN r ON l.nk IS NOT DISTINCT FROM r.nk
""",
)
def join_null_keys(spark: SparkSession, sf: str) -> DataFrame:
    left = table(spark, sf, "customer").select(
        "c_custkey", holed("c_nationkey", "c_custkey", 33).alias("nk")
    )
    right = table(spark, sf, "nation").select(
        holed("n_nationkey", "n_nationkey", 6).alias("nk"), "n_name"
    )
    return joins.join(left, right, "inner", ["nk"])


@query(
    "join_multi_key",
    """
WITH s AS (SELECT l_suppkey, l_returnflag, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2),
     t AS (SELECT l_suppkey AS supp, l_returnflag AS flag, max(l_quantity) AS top FROM lineitem
           WHERE l_linestatus = 'O' GROUP BY 1, 2)
SELECT l_suppkey, l_returnflag, qty, supp, flag, top
FROM s JOIN t ON l_suppkey = supp AND l_returnflag = flag
""",
)
def join_multi_key(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    s = groupby.groupby_agg(lines, ["l_suppkey", "l_returnflag"], {"qty": ("l_quantity", "sum")})
    opened = filter_rows(lines, mask(F.col("l_linestatus") == "O"))
    t = groupby.groupby_agg(opened, ["l_suppkey", "l_returnflag"], {"top": ("l_quantity", "max")})
    t = frame.rename(t, {"l_suppkey": "supp", "l_returnflag": "flag"})
    return joins.join(s, t, "inner", ["l_suppkey", "l_returnflag"], ["supp", "flag"])


@query(
    "join_fanout_report",
    """
WITH l AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1),
     r AS (SELECT c_custkey AS k, count(*) AS n FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1)
SELECT (SELECT sum(n) FROM l)::BIGINT AS left_rows, (SELECT sum(n) FROM r)::BIGINT AS right_rows,
       (SELECT sum(n - 1) FROM l)::BIGINT AS left_duplicates,
       (SELECT sum(n - 1) FROM r)::BIGINT AS right_duplicates,
       (SELECT sum(l.n * r.n) FROM l JOIN r ON l.k = r.k)::BIGINT AS predicted_rows
""",
)
def join_fanout_report(spark: SparkSession, sf: str) -> DataFrame:
    even = table(spark, sf, "customer").filter(F.col("c_custkey") % 2 == 0)
    return joins.fanout_report(_orders(spark, sf), even, ["o_custkey"], ["c_custkey"])


@query(
    "join_broadcast",
    "SELECT c_custkey, c_nationkey, n_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
def join_broadcast(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return joins.join(customer, nation, "inner", ["c_nationkey"], ["n_nationkey"], broadcast="right")


# --- aggregations ----------------------------------------------------------------------------


@query(
    "groupby_dropna",
    f"""
WITH {CUSTOMERS}
SELECT n_name, count(*)::BIGINT AS n FROM cust WHERE n_name IS NOT NULL GROUP BY n_name
""",
)
def groupby_dropna(spark: SparkSession, sf: str) -> DataFrame:
    return groupby.groupby_agg(customers(spark, sf), ["n_name"], {"n": ("c_custkey", "count")})


@query(
    "groupby_keepna",
    f"WITH {CUSTOMERS} SELECT n_name, count(*)::BIGINT AS n FROM cust GROUP BY n_name",
)
def groupby_keepna(spark: SparkSession, sf: str) -> DataFrame:
    return groupby.groupby_agg(
        customers(spark, sf), ["n_name"], {"n": ("c_custkey", "count")}, dropna=False
    )


@query(
    "agg_sum_zero",
    """
SELECT l_suppkey, round(coalesce(sum(CASE WHEN l_suppkey % 4 <> 0 THEN l_extendedprice END), 0), 2) AS total
FROM lineitem GROUP BY l_suppkey
""",
)
def agg_sum_zero(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(
        "l_suppkey", gaps("l_extendedprice", "l_suppkey", 4).alias("price")
    )
    summed = groupby.groupby_agg(lines, ["l_suppkey"], {"total": ("price", "sum")})
    return _rounded(summed, total=2)


@query(
    "agg_mean",
    """
SELECT l_suppkey, avg(CASE WHEN l_suppkey % 4 <> 0 THEN round(l_extendedprice * 100)::BIGINT END) AS mean_cents
FROM lineitem GROUP BY l_suppkey
""",
)
def agg_mean(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(
        "l_suppkey", F.when(F.col("l_suppkey") % 4 != 0, cents("l_extendedprice")).alias("price")
    )
    return groupby.groupby_agg(lines, ["l_suppkey"], {"mean_cents": ("price", "mean")})


@query(
    "agg_count",
    """
SELECT l_returnflag, count(CASE WHEN l_orderkey % 5 <> 0 THEN l_quantity END)::BIGINT AS n
FROM lineitem GROUP BY l_returnflag
""",
)
def agg_count(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(
        "l_returnflag", gaps("l_quantity", "l_orderkey", 5).alias("qty")
    )
    return groupby.groupby_agg(lines, ["l_returnflag"], {"n": ("qty", "count")})


@query(
    "agg_min_max",
    """
SELECT o_custkey, min(o_totalprice) AS low, max(o_totalprice) AS high, min(o_orderpriority) AS urgency
FROM orders GROUP BY o_custkey
""",
)
def agg_min_max(spark: SparkSession, sf: str) -> DataFrame:
    return groupby.groupby_agg(
        table(spark, sf, "orders"),
        ["o_custkey"],
        {
            "low": ("o_totalprice", "min"),
            "high": ("o_totalprice", "max"),
            "urgency": ("o_orderpriority", "min"),
        },
    )


@query(
    "agg_nunique",
    """
SELECT l_returnflag, count(DISTINCT CASE WHEN l_partkey % 3 <> 0 THEN l_partkey END)::BIGINT AS parts
FROM lineitem GROUP BY l_returnflag
""",
)
def agg_nunique(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(
        "l_returnflag", holed("l_partkey", "l_partkey", 3).alias("part")
    )
    return groupby.groupby_agg(lines, ["l_returnflag"], {"parts": ("part", "nunique")})


@query(
    "agg_multi",
    """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS l_quantity,
       avg(round(l_extendedprice * 100)::BIGINT) AS l_extendedprice, max(l_discount) AS l_discount,
       count(l_tax)::BIGINT AS l_tax
FROM lineitem GROUP BY l_returnflag, l_linestatus
""",
)
def agg_multi(spark: SparkSession, sf: str) -> DataFrame:
    grouped = groupby.groupby_agg(
        table(spark, sf, "lineitem").withColumn("l_extendedprice", cents("l_extendedprice")),
        ["l_returnflag", "l_linestatus"],
        {
            "l_quantity": ("l_quantity", "sum"),
            "l_extendedprice": ("l_extendedprice", "mean"),
            "l_discount": ("l_discount", "max"),
            "l_tax": ("l_tax", "count"),
        },
    )
    return _rounded(grouped, l_quantity=2)


@query(
    "agg_global",
    """
SELECT round(sum(o_totalprice), 2) AS total, count(o_orderkey)::BIGINT AS n, min(o_totalprice) AS low
FROM orders
""",
)
def agg_global(spark: SparkSession, sf: str) -> DataFrame:
    result = groupby.groupby_agg(
        table(spark, sf, "orders"),
        [],
        {
            "total": ("o_totalprice", "sum"),
            "n": ("o_orderkey", "count"),
            "low": ("o_totalprice", "min"),
        },
    )
    return _rounded(result, total=2)


@query(
    "pivot_table_mean",
    """
WITH o AS (SELECT o_custkey % 50 AS grp, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderstatus END AS st,
                  round(o_totalprice * 100)::BIGINT AS p FROM orders)
SELECT grp, avg(CASE WHEN st = 'F' THEN p END) AS "F", avg(CASE WHEN st = 'O' THEN p END) AS "O",
       avg(CASE WHEN st = 'P' THEN p END) AS "P"
FROM o WHERE st IS NOT NULL GROUP BY grp
""",
)
def pivot_table_mean(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 50).alias("grp"),
        holed("o_orderstatus", "o_orderkey", 9).alias("st"),
        cents("o_totalprice").alias("p"),
    )
    return groupby.pivot_table(orders, ["grp"], "st", "p", ["F", "O", "P"])


@query(
    "pivot_unique",
    """
WITH s AS (SELECT l_suppkey, l_returnflag, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, max(CASE WHEN l_returnflag = 'A' THEN q END) AS "A",
       max(CASE WHEN l_returnflag = 'N' THEN q END) AS "N", max(CASE WHEN l_returnflag = 'R' THEN q END) AS "R"
FROM s GROUP BY l_suppkey
""",
)
def pivot_unique(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    s = groupby.groupby_agg(lines, ["l_suppkey", "l_returnflag"], {"q": ("l_quantity", "sum")})
    return groupby.pivot(s, ["l_suppkey"], "l_returnflag", "q", ["A", "N", "R"])


# --- windows, order, duplicates, union ---------------------------------------------------------


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", "ts", "user_id", gaps("value", "event_id", 10).alias("v")
    )


EVENTS = """
ev AS (SELECT event_id, ts, user_id, CASE WHEN event_id % 10 <> 0 THEN value END AS v FROM events)
"""
WINDOW_KEYS = {"partition_by": ["user_id"], "order_by": ["ts", "event_id"]}


@query(
    "rolling_mean_3",
    f"""
WITH {EVENTS}
SELECT event_id, CASE WHEN count(v) OVER w = 3 THEN round(avg(v) OVER w, 6) END AS rolled
FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
""",
)
def rolling_mean_3(spark: SparkSession, sf: str) -> DataFrame:
    rolled = windows.rolling(_events(spark, sf), "v", 3, "mean", output="rolled", **WINDOW_KEYS)
    return _rounded(rolled.select("event_id", "rolled"), rolled=6)


@query(
    "expanding_mean",
    f"""
WITH {EVENTS}
SELECT event_id, round(avg(v) OVER (PARTITION BY user_id ORDER BY ts, event_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9) AS expanded FROM ev
""",
)
def expanding_mean(spark: SparkSession, sf: str) -> DataFrame:
    grown = windows.expanding(_events(spark, sf), "v", "mean", output="expanded", **WINDOW_KEYS)
    return _rounded(grown.select("event_id", "expanded"), expanded=9)


@query(
    "shift_1",
    f"""
WITH {EVENTS}
SELECT event_id, lag(v, 1) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM ev
""",
)
def shift_1(spark: SparkSession, sf: str) -> DataFrame:
    moved = windows.shift(_events(spark, sf), "v", 1, output="before", **WINDOW_KEYS)
    return moved.select("event_id", "before")


@query(
    "rank_average",
    f"""
WITH {EVENTS}, n AS (SELECT event_id, user_id, floor(v / 10) AS t FROM ev)
SELECT event_id, CASE WHEN t IS NOT NULL THEN
       (SELECT 0) + rank() OVER (PARTITION BY user_id ORDER BY t NULLS LAST)
       + (count(*) OVER (PARTITION BY user_id, t) - 1) / 2.0 END::DOUBLE AS r
FROM n
""",
)
def rank_average(spark: SparkSession, sf: str) -> DataFrame:
    tens = frame.derive(_events(spark, sf), {"t": F.floor(F.col("v") / 10)})
    return windows.rank(tens, "t", ["user_id"], "r").select("event_id", "r")


@query(
    "rank_dense",
    f"""
WITH {EVENTS}, n AS (SELECT event_id, user_id, floor(v / 10) AS t FROM ev)
SELECT event_id, CASE WHEN t IS NOT NULL THEN
       dense_rank() OVER (PARTITION BY user_id ORDER BY t NULLS LAST) END::DOUBLE AS r FROM n
""",
)
def rank_dense(spark: SparkSession, sf: str) -> DataFrame:
    tens = frame.derive(_events(spark, sf), {"t": F.floor(F.col("v") / 10)})
    return windows.rank(tens, "t", ["user_id"], "r", method="dense").select("event_id", "r")


@query(
    "cumsum_by_key",
    f"""
WITH {EVENTS}
SELECT event_id, CASE WHEN v IS NOT NULL THEN round(sum(v) OVER (PARTITION BY user_id ORDER BY ts, event_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) END AS running FROM ev
""",
)
def cumsum_by_key(spark: SparkSession, sf: str) -> DataFrame:
    summed = windows.cumsum(_events(spark, sf), "v", output="running", **WINDOW_KEYS)
    return _rounded(summed.select("event_id", "running"), running=4)


@query(
    "sort_nulls_last",
    f"WITH {CUSTOMERS} SELECT n_name, c_custkey FROM cust ORDER BY n_name NULLS LAST, c_custkey",
)
def sort_nulls_last(spark: SparkSession, sf: str) -> DataFrame:
    pairs = customers(spark, sf).select("n_name", "c_custkey")
    return frame.sort_values(pairs, ["n_name"], tiebreak=["c_custkey"])


@query(
    "dedup_keep_first",
    """
SELECT o_custkey, o_orderstatus, o_orderkey FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) = 1
""",
)
def dedup_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderkey")
    return windows.drop_duplicates(orders, ["o_custkey", "o_orderstatus"], "first", ["o_orderkey"])


@query(
    "dedup_keep_last",
    """
SELECT o_custkey, o_orderstatus, o_orderkey FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey DESC) = 1
""",
)
def dedup_keep_last(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderkey")
    return windows.drop_duplicates(orders, ["o_custkey", "o_orderstatus"], "last", ["o_orderkey"])


@query(
    "dedup_keep_none",
    """
SELECT o_custkey, o_orderstatus, o_orderkey FROM orders
QUALIFY count(*) OVER (PARTITION BY o_custkey, o_orderstatus) = 1
""",
)
def dedup_keep_none(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderkey")
    return windows.drop_duplicates(orders, ["o_custkey", "o_orderstatus"], False)


@query(
    "concat_union",
    """
SELECT c_custkey AS k, c_acctbal AS bal, c_mktsegment AS segment, NULL::DOUBLE AS nation FROM customer
UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_nationkey::DOUBLE FROM supplier
""",
)
def concat_union(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("segment")
    )
    b = table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("bal"), F.col("s_suppkey").alias("k")
    )
    return frame.concat(a, b)


@query(
    "diff_keys_only",
    """
WITH a AS (SELECT DISTINCT CASE WHEN o_custkey % 33 <> 0 THEN o_custkey END AS k FROM orders
           WHERE o_orderkey % 3 = 0),
     b AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0)
SELECT k, 'left_only' AS _merge FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.k IS NOT DISTINCT FROM a.k)
UNION ALL
SELECT k, 'right_only' FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.k IS NOT DISTINCT FROM b.k)
""",
)
def diff_keys_only(spark: SparkSession, sf: str) -> DataFrame:
    third = table(spark, sf, "orders").filter(F.col("o_orderkey") % 3 == 0)
    even = table(spark, sf, "customer").filter(F.col("c_custkey") % 2 == 0)
    return joins.keyed_difference(
        third.select(holed("o_custkey", "o_custkey", 33).alias("k")),
        even.select(F.col("c_custkey").alias("k")),
        ["k"],
    )


# --- Python functions ----------------------------------------------------------------------------


@query(
    "map_dict",
    """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' END AS state FROM orders
""",
)
def map_dict(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    state = frame.map_values(F.col("o_orderstatus"), {"F": "filled", "O": "open"})
    return orders.select("o_orderkey", state.alias("state"))


@query(
    "apply_pandas_udf",
    "SELECT o_orderkey, round(sqrt(o_totalprice), 6) AS root FROM orders",
)
def apply_pandas_udf(spark: SparkSession, sf: str) -> DataFrame:
    def root(values: pd.Series) -> pd.Series:
        return values**0.5

    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    rooted = frame.apply_series(F.col("o_totalprice"), root, "double")
    return orders.select("o_orderkey", F.round(rooted, 6).alias("root"))


@query(
    "apply_rowwise",
    """
SELECT l_orderkey, l_linenumber, l_partkey,
       CASE WHEN l_quantity > 10 THEN round(l_extendedprice * (1 - l_discount), 4) END AS net FROM lineitem
""",
)
def apply_rowwise(spark: SparkSession, sf: str) -> DataFrame:
    def net(rows: pd.DataFrame) -> pd.Series:
        value = rows["l_extendedprice"] * (1 - rows["l_discount"])
        return value.where(rows["l_quantity"] > 10)

    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount"
    )
    value = frame.apply_rows(lines, ["l_quantity", "l_extendedprice", "l_discount"], net, "double")
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(F.nanvl(value, F.lit(None)), 4).alias("net")
    )
