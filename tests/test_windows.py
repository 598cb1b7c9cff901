import numpy as np
import pandas as pd
import pytest

from frames import assert_same, to_spark
from parity.operators import windows
from parity.operators.positions import with_positions
from parity.operators.frame import order_columns

RNG = np.random.default_rng(7)
N = 400
PDF = pd.DataFrame(
    {
        "g": np.where(RNG.random(N) < 0.6, "hot", RNG.choice(["a", "b", "c"], N)),
        "t": RNG.permutation(N),
        "v": np.where(RNG.random(N) < 0.15, np.nan, RNG.integers(0, 12, N).astype(float)),
    }
).sort_values(["g", "t"])
KEYS = {"partition_by": ["g"], "order_by": ["t"], "output": "out"}

#: None: one window per group. 25: the hot group is cut into pieces.
LIMITS = [None, 25]


@pytest.fixture(scope="module")
def df(spark):
    return to_spark(spark, PDF, "g string, t bigint, v double").repartition(5)


@pytest.mark.parametrize("limit", LIMITS)
@pytest.mark.parametrize(("n", "fn", "least"), [(3, "mean", None), (4, "sum", 2), (30, "max", 5), (2, "min", None)])
def test_rolling(df, limit, n, fn, least):
    got = windows.rolling(df, "v", n, fn, min_periods=least, max_group_rows=limit, **KEYS)
    rolled = PDF.groupby("g")["v"].rolling(n, min_periods=least)
    expected = PDF.assign(out=getattr(rolled, fn)().reset_index(level=0, drop=True))
    assert_same(got, expected)


@pytest.mark.parametrize("limit", LIMITS)
@pytest.mark.parametrize("k", [1, -1, 5, -30, 0])
def test_shift(df, limit, k):
    got = windows.shift(df, "v", k, max_group_rows=limit, **KEYS)
    assert_same(got, PDF.assign(out=PDF.groupby("g")["v"].shift(k)))


@pytest.mark.parametrize("limit", LIMITS)
@pytest.mark.parametrize("fn", ["mean", "sum", "min", "max"])
def test_expanding(df, limit, fn):
    got = windows.expanding(df, "v", fn, max_group_rows=limit, **KEYS)
    grown = getattr(PDF.groupby("g")["v"].expanding(), fn)().reset_index(level=0, drop=True)
    assert_same(got, PDF.assign(out=grown))


@pytest.mark.parametrize("limit", LIMITS)
def test_cumsum(df, limit):
    got = windows.cumsum(df, "v", max_group_rows=limit, **KEYS)
    assert_same(got, PDF.assign(out=PDF.groupby("g")["v"].cumsum()))


@pytest.mark.parametrize("limit", LIMITS)
@pytest.mark.parametrize("up", [True, False])
@pytest.mark.parametrize("method", ["average", "min", "max", "dense", "first"])
def test_rank(df, limit, method, up):
    got = windows.rank(df, "v", ["g"], "out", method, up, ["t"], max_group_rows=limit)
    expected = PDF.assign(out=PDF.groupby("g")["v"].rank(method=method, ascending=up))
    assert_same(got, expected)


def test_rank_of_many_distinct_values(spark):
    pdf = pd.DataFrame({"g": ["h"] * 300, "v": RNG.random(300)})
    got = windows.rank(to_spark(spark, pdf, "g string, v double"), "v", ["g"], "out", "dense", max_group_rows=20)
    assert_same(got, pdf.assign(out=pdf.groupby("g")["v"].rank(method="dense")))


def test_positions(spark, df):
    placed = with_positions(df, ["g"], order_columns(["t"]), "p", partitions=13)
    assert_same(placed, PDF.assign(p=PDF.groupby("g").cumcount()))
    everywhere = with_positions(df, [], order_columns(["t"]), "p", partitions=13)
    assert_same(everywhere, PDF.assign(p=PDF.t.rank().astype(int) - 1))


@pytest.mark.parametrize("keep", ["first", "last", False])
def test_drop_duplicates(df, keep):
    got = windows.drop_duplicates(df, ["g", "v"], keep, ["t"])
    assert_same(got, PDF.sort_values("t").drop_duplicates(["g", "v"], keep=keep))


def test_keeping_one_is_limited_before_the_shuffle(df):
    plan = windows.drop_duplicates(df, ["g"], "first", ["t"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_orders_are_required(df):
    with pytest.raises(ValueError):
        windows.rolling(df, "v", 3, "mean", [], ["t"], "out")
    with pytest.raises(ValueError):
        windows.cumsum(df, "v", ["g"], [], "out")
    with pytest.raises(ValueError):
        windows.drop_duplicates(df, ["g"], "first")


def test_row_frame_alone_is_not_rolling(df):
    """The count gate is what makes the first rows of each group null."""
    got = windows.rolling(df, "v", 3, "mean", min_periods=1, max_group_rows=None, **KEYS)
    gated = windows.rolling(df, "v", 3, "mean", max_group_rows=None, **KEYS)
    assert got.filter("out is null").count() < gated.filter("out is null").count()
