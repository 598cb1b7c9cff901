import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from frames import assert_same, to_spark
from parity.functions.masks import and_, filter_rows, mask, ne, not_, or_, query
from parity.functions.numbers import round_half_even, with_fixed, with_ratio_texts
from parity.functions.types import normalize
from parity.operators import frame

PDF = pd.DataFrame(
    {
        "a": [1.0, None, 3.0, -2.5, 0.0, 2.5],
        "b": ["x", "y", None, "x", "z", None],
        "k": [1, 2, 3, 4, 5, 6],
    }
)
SCHEMA = "a double, b string, k bigint"


@pytest.fixture(scope="module")
def df(spark):
    return to_spark(spark, PDF, SCHEMA)


@pytest.mark.parametrize(
    ("ours", "theirs"),
    [
        (lambda: mask(F.col("a") >= 1), lambda p: p.a >= 1),
        (lambda: ne(F.col("b"), "x"), lambda p: p.b != "x"),
        (lambda: ne(F.col("a"), F.col("k")), lambda p: p.a != p.k),
        (lambda: not_(mask(F.col("a") >= 1)), lambda p: ~(p.a >= 1)),
        (lambda: ~(mask(F.col("a") >= 1) & ne(F.col("b"), "x")), lambda p: ~((p.a >= 1) & (p.b != "x"))),
        (lambda: or_(mask(F.col("a") > 2), mask(F.col("b") == "x")), lambda p: (p.a > 2) | (p.b == "x")),
        (lambda: and_(mask(F.col("a") > 0), not_(mask(F.col("b") == "x"))), lambda p: (p.a > 0) & ~(p.b == "x")),
    ],
)
def test_masks_are_two_valued(df, ours, theirs):
    assert_same(filter_rows(df, ours()), PDF[theirs(PDF)])


def test_naive_not_equal_loses_rows(df):
    assert df.filter(F.col("b") != "x").count() < filter_rows(df, ne(F.col("b"), "x")).count()


def test_and_or_masks_reach_the_scan(spark, tmp_path, df):
    path = str(tmp_path / "t")
    df.write.parquet(path)
    kept = filter_rows(spark.read.parquet(path), and_(mask(F.col("a") >= 1), ne(F.col("b"), "x"))).select("k")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(a,1.0)" in plan
    assert "Or(IsNull(b),Not(EqualTo(b,x)))" in plan


def test_query_text(df):
    assert_same(query(df, "a > 0 and k < 6"), PDF.query("a > 0 and k < 6"))


def test_round_is_half_even(spark):
    pdf = pd.DataFrame({"v": [0.5, 1.5, 2.5, -0.5, 0.125, 0.375, 2.675]})
    df = to_spark(spark, pdf, "v double")
    for n in (0, 1, 2):
        got = df.select("v", round_half_even(F.col("v"), n).alias("r"))
        assert_same(got, pdf.assign(r=pdf.v.round(n)))


def test_numbers_print_as_python_prints_them(spark):
    values = [1.005, 0.125, 1.015, 2.675, 1.0, 1.25, 1.38, 0.0, 9.999995, 99999.95, 0.00012345, 1e7, 2.5]
    values += [i / 64 for i in range(0, 4000, 7)] + [i / 1000 for i in range(0, 4000, 5)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    two = with_fixed(df, "x", "2", "a").collect()
    assert [r.a for r in two] == [f"{r.x:.2f}" for r in two]
    quoted = with_ratio_texts(df.distinct(), "array(x)", "t").collect()
    for r in quoted:
        assert sorted(r.t) == sorted([f"{r.x:.2f}", f"{r.x:.1f}", f"{r.x:g}"])


def test_large_numbers_print_and_never_fail(spark):
    values = [1e12 + 0.125, 4.5e13 + 0.375, 2.0**53 - 1, 2.0**53 + 2, 9.1e18, 9.3e18, 1e17, 1e20, 1e23, 1.5e30, 2.0**114]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 1, 2):
        got = with_fixed(df, "x", str(digits), "a").collect()
        assert [r.a for r in got] == [f"{r.x:.{digits}f}" for r in got]
    beyond = spark.createDataFrame([(1e40,), (1e300,), (None,)], "x double")
    assert [bool(r.a) for r in with_fixed(beyond, "x", "2", "a").collect()] == [True, True, False]
    quoted = with_ratio_texts(df, "array(x)", "t").collect()
    assert [sorted(r.t) for r in quoted] == [sorted([f"{r.x:.2f}", f"{r.x:.1f}", f"{r.x:g}"]) for r in quoted]


def test_fillna(df):
    assert_same(frame.fillna(df, {"a": -1, "b": "?"}), PDF.fillna({"a": -1, "b": "?"}))
    with pytest.raises(TypeError):
        frame.fillna(df, 0)


def test_fillna_fills_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (1.0,)], "a double")
    assert sorted(r.a for r in frame.fillna(df, 0).collect()) == [0.0, 0.0, 1.0]
    assert normalize(df).filter("a is null").count() == 2


@pytest.mark.parametrize("options", [{}, {"subset": ["b"]}, {"how": "all", "subset": ["a", "b"]}, {"thresh": 3}])
def test_dropna(df, options):
    expected = PDF.dropna(**options)
    assert_same(frame.dropna(df, **options), expected)


def test_astype_truncates_and_raises(spark):
    pdf = pd.DataFrame({"v": [1.9, -1.9, 0.0]})
    assert_same(frame.astype(to_spark(spark, pdf, "v double"), {"v": "bigint"}), pdf.astype({"v": "int64"}))
    holes = spark.createDataFrame([(None,), (1.0,)], "v double")
    with pytest.raises(PySparkException):
        frame.astype(holes, {"v": "bigint"}).collect()
    assert frame.astype(holes, {"v": "bigint"}, errors="null").filter("v is null").count() == 1
    bad = spark.createDataFrame([("x",), ("2",)], "v string")
    with pytest.raises(PySparkException):
        frame.astype(bad, {"v": "bigint"}).collect()


def test_overflow_raises_unless_tolerated(spark):
    df = spark.createDataFrame([(1 << 62,)], "v bigint")
    with pytest.raises(PySparkException):
        frame.derive(df, {"w": F.col("v") * 4}).collect()
    assert frame.derive(df, {"w": frame.try_multiply(F.col("v"), F.lit(4))}).first().w is None


def test_concat_widens_and_aligns(spark):
    a = pd.DataFrame({"x": [1, 2], "y": ["a", "b"]})
    b = pd.DataFrame({"y": ["c"], "z": [7]})
    got = frame.concat(to_spark(spark, a, "x bigint, y string"), to_spark(spark, b, "y string, z bigint"))
    assert dict(got.dtypes) == {"x": "double", "y": "string", "z": "double"}
    assert_same(got, pd.concat([a, b], ignore_index=True))


def test_sort_puts_missing_last_in_both_directions(df):
    for up in (True, False):
        got = [r.k for r in frame.sort_values(df, ["b"], up, ["k"]).collect()]
        expected = PDF.sort_values(["b", "k"], ascending=[up, True], na_position="last").k.tolist()
        assert got == expected


def test_head_takes_the_declared_order(df):
    got = [r.k for r in frame.head(df, 2, ["a"], ascending=False).collect()]
    assert got == PDF.sort_values("a", ascending=False).head(2).k.tolist()


def test_reset_index_adds_nothing(df):
    assert frame.reset_index(df).columns == df.columns


def test_map_and_lookup(spark, df):
    got = df.select("k", frame.map_values(F.col("b"), {"x": 1, "y": 2}).alias("m"))
    assert_same(got, PDF[["k"]].assign(m=PDF.b.map({"x": 1, "y": 2})))
    table = spark.createDataFrame([("x", 1), ("y", 2)], "key string, value int")
    assert_same(frame.map_lookup(df, "b", table, "m").select("k", "m"), PDF[["k"]].assign(m=PDF.b.map({"x": 1, "y": 2})))


def test_apply_returns_missing_values(df):
    got = df.select("k", frame.apply_series(F.col("a"), lambda s: s.where(s > 0) * 2, "double").alias("v"))
    got = got.withColumn("v", F.nanvl("v", F.lit(None)))
    assert_same(got, PDF[["k"]].assign(v=PDF.a.where(PDF.a > 0) * 2))


def test_drop_unknown_column_raises(df):
    with pytest.raises(KeyError):
        frame.drop(df, ["nope"])


def test_nan_is_missing_in_every_operator(spark):
    from parity.functions.masks import filter_rows, mask, ne, not_, or_
    from parity.operators import groupby, joins, windows

    nan = float("nan")
    df = spark.createDataFrame([(1, 1.0), (2, nan), (3, None), (4, 7.0)], "k bigint, x double")
    keys = lambda out: sorted(r.k for r in out.collect())
    assert keys(filter_rows(df, mask(F.col("x") >= 5))) == [4]
    assert keys(filter_rows(df, not_(mask(F.col("x") >= 5)))) == [1, 2, 3]
    assert keys(filter_rows(df, ne(F.col("x"), 7.0))) == [1, 2, 3]
    assert keys(filter_rows(df, ne(F.col("x"), F.col("x")))) == [2, 3]
    assert keys(filter_rows(df, or_(mask(F.col("x") > 100), mask(F.col("k") == 2)))) == [2]
    aggregates = {"s": ("x", "sum"), "m": ("x", "mean"), "c": ("x", "count"), "hi": ("x", "max"), "u": ("x", "nunique")}
    assert tuple(groupby.groupby_agg(df, [], aggregates).first()) == (8.0, 4.0, 2, 7.0, 2)
    assert groupby.groupby_agg(df, ["x"], {"n": ("k", "count")}).count() == 2
    order = {"partition_by": ["g"], "order_by": ["k"]}
    g = df.withColumn("g", F.lit(1))
    assert [r.o for r in windows.expanding(g, "x", "sum", output="o", **order).orderBy("k").collect()] == [1.0, 1.0, 1.0, 8.0]
    assert [r.o for r in windows.rank(g, "x", ["g"], "o").orderBy("k").collect()] == [1.0, None, None, 2.0]
    assert [r.k for r in frame.sort_values(df, ["x"], ascending=False, tiebreak=["k"]).collect()] == [4, 1, 2, 3]
    assert joins.join(df, df.select("x"), "inner", ["x"]).count() == 6
    assert windows.drop_duplicates(df, ["x"], order_by=["k"]).count() == 3


def test_whole_numbers_of_missing_values_are_missing(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, None), (3, 2.5)], "k bigint, v double")
    whole = frame.derive(df, {
        "down": F.floor("v"), "up": F.ceil("v"), "cast": F.col("v").cast("bigint"), "tens": F.floor(F.col("v") / 10),
    })
    got = {r.k: tuple(r)[2:] for r in whole.collect()}
    assert got == {1: (None,) * 4, 2: (None,) * 4, 3: (2, 3, 2, 0)}


def test_missing_values_that_are_not_dropped_are_null(spark):
    df = spark.createDataFrame([(1, float("nan")), (None, 1.0), (3, 2.5)], "k bigint, v double")
    assert {tuple(r) for r in frame.dropna(df, subset=["k"]).collect()} == {(1, None), (3, 2.5)}
    assert {tuple(r) for r in frame.dropna(df).collect()} == {(3, 2.5)}
