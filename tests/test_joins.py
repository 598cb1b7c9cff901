import itertools

import pandas as pd
import pytest
from pyspark.sql import functions as F

from frames import assert_same, rows_of_spark, to_spark
from parity.operators import groupby, joins, skew

LEFT = pd.DataFrame({"k": [1, 2, 2, None, 5, None], "v": [10, 20, 21, 30, 50, 31]})
RIGHT = pd.DataFrame({"k": [2, 2, None, 7, 1], "v": ["a", "b", "c", "d", "e"]})


@pytest.fixture(scope="module")
def sides(spark):
    return to_spark(spark, LEFT, "k double, v bigint"), to_spark(spark, RIGHT, "k double, v string")


@pytest.mark.parametrize(
    ("how", "limit"), list(itertools.product(["inner", "left", "right", "outer"], [None, 1]))
)
def test_merge_matches_missing_keys(sides, how, limit):
    """With and without the plan that splits a hot key."""
    got = joins.join(*sides, how, ["k"], indicator=True, max_group_rows=limit)
    expected = LEFT.merge(RIGHT, on="k", how=how, indicator=True)
    expected["_merge"] = expected["_merge"].astype(str)
    assert_same(got, expected)


def test_hot_outer_join_is_planned_in_parts(sides):
    left, right = sides
    plain = joins.join(left, right, "outer", ["k"], max_group_rows=None)
    split = joins.join(left, right, "outer", ["k"], max_group_rows=1)
    assert "FullOuter" in plain._jdf.queryExecution().optimizedPlan().toString()
    text = split._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in text and "LeftAnti" in text and "Inner" in text


def test_naive_join_loses_missing_keys(sides):
    left, right = sides
    assert left.join(right, left.k == right.k).count() < joins.join(left, right, "inner", ["k"]).count()


def test_different_names_and_semi_anti(sides):
    left, right = sides
    renamed = right.withColumnRenamed("k", "q")
    got = joins.join(left, renamed, "left", ["k"], ["q"])
    assert_same(got, LEFT.merge(RIGHT.rename(columns={"k": "q"}), left_on="k", right_on="q", how="left"))
    inside = LEFT[LEFT.k.isin(RIGHT.k)]
    assert_same(joins.join(left, right, "semi", ["k"]), inside)
    assert_same(joins.join(left, right, "anti", ["k"]), LEFT.drop(inside.index))


def test_cross(sides, monkeypatch):
    left, right = sides
    want = LEFT.merge(RIGHT, how="cross")
    assert_same(joins.join(left, right, "cross"), want)
    monkeypatch.setattr(skew, "BROADCAST_LIMIT_ROWS", 0)
    apart = joins.join(left, right, "cross")
    assert "Broadcast" not in apart._jdf.queryExecution().optimizedPlan().toString()
    assert_same(apart, want)


def test_sizes_are_measured_and_not_estimated(spark, tmp_path):
    """Twenty million rows of one key compress to almost nothing."""
    path = str(tmp_path / "one_key")
    spark.range(20_000_000).selectExpr("1 AS k").write.parquet(path)
    rows = spark.read.parquet(path)
    assert not skew.broadcastable(rows)
    assert skew.has_hot_group(rows, ["k"], skew.MAX_GROUP_ROWS)
    assert skew.broadcastable(rows.limit(10))
    with pytest.raises(ValueError, match="broadcast limit"):
        joins.join(rows, rows, "inner", ["k"], broadcast="right")


def test_semi_and_anti_keys_are_distinct(sides):
    left, right = sides
    for how in ("semi", "anti"):
        plan = joins.join(left, right, how, ["k"])._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" in plan


def test_key_guards(sides, spark):
    left, right = sides
    with pytest.raises(joins.JoinKeyError):
        joins.join(left, right, "inner", ["k"], ["v"])
    with pytest.raises(joins.JoinKeyError):
        joins.join(left, right, "inner", ["k"], [])
    with pytest.raises(ValueError, match="broadcast"):
        joins.join(left, spark.range(1 << 40).withColumn("k", F.col("id").cast("double")), "inner", ["k"], broadcast="right")


def test_fanout_report_predicts_the_join(sides):
    row = joins.fanout_report(*sides, ["k"]).first()
    assert (row.left_rows, row.right_rows, row.left_duplicates, row.right_duplicates) == (6, 5, 2, 1)
    assert row.predicted_rows == joins.join(*sides, "inner", ["k"]).count() == len(LEFT.merge(RIGHT, on="k"))


def test_keyed_difference(sides):
    got = rows_of_spark(joins.keyed_difference(*sides, ["k"]))
    assert got == [("5", "left_only"), ("7", "right_only")]


def test_groupby_drops_missing_keys_and_sums_to_zero(spark):
    pdf = pd.DataFrame({"g": ["a", "a", None, "b", "c"], "v": [1.0, None, 5.0, None, 2.0]})
    df = to_spark(spark, pdf, "g string, v double")
    aggs = {f: ("v", f) for f in ("sum", "mean", "count", "min", "max", "nunique")}
    for dropna in (True, False):
        got = groupby.groupby_agg(df, ["g"], aggs, dropna=dropna)
        expected = pdf.groupby("g", dropna=dropna)["v"].agg(list(aggs)).reset_index()
        assert_same(got, expected)
    assert df.groupBy("g").agg(F.sum("v")).count() != groupby.groupby_agg(df, ["g"], aggs).count()
    assert groupby.groupby_agg(df, [], {"s": ("v", "sum")}).first().s == 8.0


def test_pivots(spark):
    pdf = pd.DataFrame({"i": [1, 1, 2, 2, 3], "c": ["x", "y", "x", "x", None], "v": [1.0, 2.0, 3.0, 5.0, 9.0]})
    df = to_spark(spark, pdf, "i bigint, c string, v double")
    got = groupby.pivot_table(df, ["i"], "c", "v", ["x", "y"])
    expected = pdf.pivot_table(index="i", columns="c", values="v").reset_index()
    assert_same(got, expected)
    unique = df.filter("v < 4 and c is not null")
    expected = pdf[(pdf.v < 4)].pivot(index="i", columns="c", values="v").reset_index()
    assert_same(groupby.pivot(unique, ["i"], "c", "v", ["x", "y"]), expected)
    with pytest.raises(Exception, match="duplicate entries"):
        groupby.pivot(df, ["i"], "c", "v", ["x", "y"]).collect()
    assert groupby.labels_of(df, "c") == ["x", "y"]
