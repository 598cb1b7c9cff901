import pandas as pd
import pytest
from pyspark.sql import functions as F

from frames import rows_of_spark, to_spark
from parity.functions.numbers import within_tolerance
from parity.functions.types import dtype_family
from parity.operators import compare as C
from parity.operators.stats import column_stats, dataset_stats

REF = pd.DataFrame({"country": ["DE", "ES", "FR"], "revenue": [100.0, 200.0, 300.0]})
SCHEMA = "country string, revenue double"


@pytest.fixture(scope="module")
def ref(spark):
    return to_spark(spark, REF, SCHEMA).cache()


def status(result):
    return result.verdict.first().status


def failed(result):
    return {r.name for r in result.checks.collect() if not r.passed}


def test_identical_frames_pass(ref):
    result = C.compare(ref, ref.repartition(3), ["country"], checks=C.KNOWN_CHECKS)
    assert status(result) == "PASS"
    assert result.differences.isEmpty()


def test_noise_within_tolerance_passes(ref):
    noisy = ref.withColumn("revenue", F.col("revenue") * (1 + 1e-13))
    assert status(C.compare(ref, noisy, ["country"])) == "PASS"


def test_beyond_tolerance_fails(ref):
    off = ref.withColumn("revenue", F.when(F.col("country") == "FR", 301.0).otherwise(F.col("revenue")))
    result = C.compare(ref, off, ["country"], checks=C.KNOWN_CHECKS)
    assert status(result) == "FAIL"
    assert failed(result) == {"numeric_tolerance", "aggregate_checksums", "column_statistics"}
    row = result.differences.filter("check = 'numeric_tolerance'").first()
    assert (row.column, row.category, row.reference, row.candidate) == ("revenue", "floating_point", "300.0", "301.0")
    assert "country=FR" in row.detail and "1 rows" in row.detail


def test_phantom_null_group(spark, ref):
    extra = ref.unionByName(spark.createDataFrame([(None, 143967.81)], SCHEMA))
    result = C.compare(ref, extra, ["country"])
    assert status(result) == "FAIL"
    assert {"row_count", "aggregate_checksums"} <= failed(result)
    rows = result.differences.filter("check = 'row_count'").collect()
    assert [r.category for r in rows] == ["null_semantics"]


def test_row_order_does_not_matter(ref):
    assert status(C.compare(ref, ref.orderBy(F.desc("country")), ["country"])) == "PASS"


def test_a_missing_row_is_named(ref):
    result = C.compare(ref, ref.filter("country != 'FR'"), ["country"])
    assert status(result) == "FAIL"
    found = result.differences.filter("check = 'numeric_tolerance'").collect()
    assert [(r.reference, r.candidate) for r in found] == [("country=FR", "absent")]


def test_schema_check(spark, ref):
    def diff(candidate):
        return [(r.column, r.category) for r in C.schema_differences(ref, candidate).collect()]

    assert diff(ref.drop("revenue")) == [("revenue", None)]
    assert diff(ref.withColumn("index", F.lit(1))) == [("index", "index_semantics")]
    assert diff(ref.withColumn("revenue", F.col("revenue").cast("bigint"))) == [("revenue", "type_coercion")]
    assert diff(ref.withColumn("revenue", F.col("revenue").cast("float"))) == []
    swapped = C.schema_differences(ref, ref.select("revenue", "country")).collect()
    assert [r.detail for r in swapped] == ["columns in a different order"]
    assert dtype_family(spark.range(1).schema["id"].dataType) == "integer"


def test_null_counts(spark):
    a = spark.createDataFrame([("x", 0.0), ("y", 1.0)], "k string, v double")
    b = spark.createDataFrame([("x", None), ("y", 1.0)], "k string, v double")
    result = C.compare(a, b, ["k"], checks=["null_counts"])
    assert [(r.column, r.category) for r in result.differences.collect()] == [("v", "null_semantics")]


def test_nan_counts_as_missing(spark):
    a = spark.createDataFrame([("x", float("nan")), ("y", 1.0)], "k string, v double")
    b = spark.createDataFrame([("x", None), ("y", 1.0)], "k string, v double")
    assert status(C.compare(a, b, ["k"], checks=C.KNOWN_CHECKS)) == "PASS"


def test_duplicates(ref):
    twice = ref.unionByName(ref.filter("country = 'DE'"))
    result = C.compare(ref, twice, ["country"])
    found = result.differences.filter("check = 'duplicate_counts'").collect()
    assert {r.category for r in found} == {"duplicate_explosion"} and len(found) == 2


def test_a_check_that_cannot_run_is_an_error(spark, ref):
    assert status(C.compare(ref, ref, ["nope"])) == "ERROR"
    assert status(C.compare(ref, ref, ["country"], checks=["lineage"])) == "ERROR"
    assert status(C.compare(ref, ref, ["country"], checks=[])) == "ERROR"
    assert C.error_verdict(spark, "no output").first().status == "ERROR"


@pytest.mark.parametrize("keys", [[], ["country"]])
def test_sorted_rows_when_keys_do_not_help(spark, keys):
    a = spark.createDataFrame([("FR", 1.0), ("FR", 2.0)], SCHEMA)
    result = C.compare(a, a.orderBy(F.desc("revenue")), keys)
    assert status(result) == "PASS"
    detail = result.checks.filter("name = 'numeric_tolerance'").first().detail
    assert ("keys not unique" in detail) if keys else ("no usable keys" in detail)
    changed = spark.createDataFrame([("FR", 1.0), ("FR", 2.5)], SCHEMA)
    found = C.compare(a, changed, keys).differences.filter("check = 'numeric_tolerance'").collect()
    assert [(r.column, r.reference, r.candidate) for r in found] == [("revenue", "2.0", "2.5")]
    assert "position 1" in found[0].detail
    fewer = C.compare(a, a.limit(1), keys, checks=["numeric_tolerance"])
    assert status(fewer) == "FAIL"


def test_sorted_alignment_against_brute_force(spark):
    """Many equal rows, few distinct ones, blocks of seven positions."""
    pdf = pd.DataFrame({"a": [i % 3 for i in range(200)], "b": [None if i % 7 == 0 else float(i % 5) for i in range(200)]})
    other = pdf.copy()
    other.loc[::11, "b"] = 9.0
    schema = "a bigint, b double"
    cells = C.sorted_cells(to_spark(spark, pdf, schema), to_spark(spark, other, schema), block=7).collect()
    got = {(r.column, r.pos + i) for r in cells for i in range(r.n)}
    x = pdf.sort_values(["a", "b"]).reset_index(drop=True)
    y = other.sort_values(["a", "b"]).reset_index(drop=True)
    expected = set()
    for c in ("a", "b"):
        for i in range(200):
            p, q = x[c][i], y[c][i]
            if not (p == q or (pd.isna(p) and pd.isna(q))):
                expected.add((c, i))
    assert got == expected and len(expected) > 10


def test_key_facts_name_the_keys_in_question(spark):
    schema = "k int, u string, v string"
    rows = [(1, None, "x"), (2, "x", None), (3, "y", "z"), (None, "q", "q"), (5, "a", "b")]
    other = [(1, "x", None), (2, "x", None), (3, "y", "z"), (None, "q", "w"), (6, "a", "b")]
    a, b = spark.createDataFrame(rows, schema), spark.createDataFrame(other, schema)
    facts = C.key_facts(a, b, ["k"])
    assert facts.unique and {r["__k0"] for r in facts.suspects.collect()} == {1, None, 5, 6} and facts.count == 4
    want = sorted(map(str, C.all_keyed_differences(C.keyed_cells(a, b, ["k"])).collect()))
    got = C.compare(a, b, ["k"], checks=["numeric_tolerance"])
    assert sorted(map(str, got.all_differences.collect())) == want and len(want) == 5
    assert C.key_facts(a.union(a), b, ["k"]).repeats == (5, 0)
    assert C.key_facts(a, a, ["k"]).count == 0
    assert C.key_facts(a.limit(0), b.limit(0), ["k"]).unique
    assert C.key_facts(a, b.withColumn("v", F.array("v")), ["k"]) is None
    wide = b.withColumn("k", F.col("k").cast("bigint"))
    assert status(C.compare(a, wide, ["k"], checks=["numeric_tolerance"])) == "FAIL"


def test_fractions_are_held_against_each_other_by_key(spark):
    rows = "(1, 100D, 1.00, 'a'), (2, 0D, 2.00, 'b'), (3, NULL, 3.00, 'c'), (4, 4D, NULL, 'd'), (5, -5D, 5.00, NULL)"
    a = spark.sql(f"SELECT * FROM VALUES {rows} AS t(k, v, w, t)")
    noisy = a.withColumn("v", F.col("v") * (1 + 1e-13))
    assert C.key_facts(a, noisy, ["k"]).count == 0
    moved = a.withColumns({"v": F.when(F.col("k") == 3, 0.0).when(F.col("k") == 5, 5.0).otherwise(F.col("v"))})
    assert {r["__k0"] for r in C.key_facts(a, moved, ["k"]).suspects.collect()} == {3, 5}
    for other in (noisy, moved, a.withColumn("w", F.lit(1).cast("decimal(10,2)"))):
        want = sorted(map(str, C.all_keyed_differences(C.keyed_cells(a, other, ["k"])).collect()))
        got = C.compare(a, other, ["k"], checks=["numeric_tolerance"]).all_differences
        assert sorted(map(str, got.collect())) == want


@pytest.mark.parametrize(
    ("left", "right", "close"),
    [
        (None, None, True), (None, 1.0, False), (1.0, 1.0, True), (1.0, 1.0 + 1e-12, True), (1.0, 1.1, False),
        (float("inf"), float("inf"), True), (float("inf"), 1.0, False), (0.0, 1e-30, True), (0.0, -0.0, True),
    ],
)
def test_tolerance(spark, left, right, close):
    df = spark.createDataFrame([(left, right)], "a double, b double")
    assert df.selectExpr(f"{within_tolerance('a', 'b', 1e-9)} AS r").first().r is close


def test_samples_are_capped_but_counts_are_not(spark):
    a = spark.range(100).select(F.col("id").alias("k"), F.lit(1.0).alias("v"))
    b = a.withColumn("v", F.lit(2.0))
    found = C.compare(a, b, ["k"], checks=["numeric_tolerance"]).differences.collect()
    assert len(found) == 10 and all("100 rows" in r.detail for r in found)
    moved = a.withColumn("k", F.col("k") + 1000)
    assert C.compare(a, moved, ["k"], checks=["numeric_tolerance"]).differences.count() == 20


@pytest.mark.parametrize(
    ("mutate", "checks"),
    [
        (lambda d: d.filter("id != 7"), {"row_count", "numeric_tolerance", "aggregate_checksums"}),
        (lambda d: d.unionByName(d.filter("id = 7")), {"row_count", "duplicate_counts", "numeric_tolerance", "aggregate_checksums"}),
        (lambda d: d.withColumn("s", F.when(F.col("id") != 7, F.col("s"))), {"null_counts", "numeric_tolerance", "aggregate_checksums"}),
        (lambda d: d.withColumn("s", F.when(F.col("id") == 7, "zz").otherwise(F.col("s"))), {"numeric_tolerance", "aggregate_checksums"}),
        (lambda d: d.withColumn("x", F.col("x") + (F.col("id") == 7).cast("int")), {"numeric_tolerance", "aggregate_checksums"}),
        (lambda d: d.withColumn("x", F.col("x") + (F.col("id") == 7).cast("int") - (F.col("id") == 8).cast("int")), {"numeric_tolerance"}),
    ],
)
def test_each_mutation_is_caught_by_the_right_checks(spark, mutate, checks):
    df = spark.range(50).select(
        "id", F.concat(F.lit("s"), (F.col("id") % 9).cast("string")).alias("s"), (F.col("id") * 1.5).alias("x")
    )
    result = C.compare(df, mutate(df), ["id"])
    assert status(result) == "FAIL" and failed(result) == checks


def test_external_check_moves_the_verdict(ref):
    checks = C.compare(ref, ref, ["country"]).checks
    assert C.verdict(C.with_external_check(checks, "generated_tests", True)).first().status == "PASS"
    assert C.verdict(C.with_external_check(checks, "generated_tests", False)).first().status == "FAIL"


def test_summary_and_categories(ref):
    result = C.compare(ref, ref.filter("country != 'FR'").withColumn("i", F.lit(1)), ["country"])
    flat = C.summary(result.checks).first()
    assert not (flat.schema_match or flat.row_count_match or flat.numeric_tolerance_passed)
    assert flat.failed_checks == ["aggregate_checksums", "numeric_tolerance", "row_count", "schema"]
    grouped = {r.category: r["differences"] for r in C.by_category(result.differences).collect()}
    assert grouped["index_semantics"] == 1 and grouped["null_semantics"] == 1


def test_statistics(spark):
    pdf = pd.DataFrame({"b": [True, False, True, True], "i": [1, 1, 2, 3], "f": [0.5, None, 0.5, 2.0], "s": ["a", None, "a", "b"]})
    df = to_spark(spark, pdf, "b boolean, i bigint, f double, s string")
    got = {r.column: r for r in column_stats(df).collect()}
    assert (got["b"].numeric_sum, got["b"].distinct_count) == (3.0, 2)
    assert (got["f"].null_count, got["f"].distinct_count, got["f"].numeric_sum) == (1, 2, 3.0)
    assert (got["s"].null_count, got["s"].distinct_count, got["s"].numeric_sum) == (1, 2, None)
    assert (got["i"].numeric_min, got["i"].numeric_max) == (1.0, 3.0)
    row = dataset_stats(df.unionByName(df.limit(1)), ["i"]).first()
    assert (row.row_count, row.duplicate_row_count) == (5, 1)
    assert row.duplicate_key_count == 2


def test_keyed_cells_with_missing_key(spark):
    a = spark.createDataFrame([(None, 1.0), (1, 2.0)], "k bigint, v double")
    b = spark.createDataFrame([(None, 1.0), (2, 2.0)], "k bigint, v double")
    got = rows_of_spark(C.keyed_cells(a, b, ["k"]).select("kind", "key"))
    assert got == [("left_only", "k=1"), ("right_only", "k=2")]
