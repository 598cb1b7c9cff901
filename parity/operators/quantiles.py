"""Exact order statistics per group, for groups of any size.

A group of up to ``EXACT_ROWS`` values is sorted as one array. The ranks of larger groups are found by radix selection:
every double has a 64-bit integer of the same order, and each round counts the values of a group by the next digit of
that integer. The counts combine before their shuffle and are at most 2^DIGIT for a group and prefix, so neither the size
of a group nor its ties put much into one task. A rank goes on into the one bucket that holds it, until the bucket is a
single value or small enough to be sorted. Nothing is approximate, and six rounds settle any data.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parity.operators.skew import broadcastable
from parity.session import pinned

#: Values of a group or bucket that are sorted as one array.
EXACT_ROWS = 10_000

#: Bits of a digit.
DIGIT = 12


def half_even(column: Column) -> Column:
    return F.rint(column).cast("bigint")


#: name -> (fraction, lowest rank, highest rank) from the group size n; the statistic is their mean
MEDIAN = (0.5, lambda n: F.floor((n - 1) / 2), lambda n: F.ceil((n - 1) / 2))
P75 = (0.75, lambda n: half_even((n - 1) * 0.75), lambda n: half_even((n - 1) * 0.75))

Statistic = tuple[float, Callable[[Column], Column], Callable[[Column], Column]]


def order_key(value: Column) -> Column:
    """The 64-bit integer whose order among others is that of the double: its sign-magnitude bits as a signed number,
    put together by exact arithmetic. Both zeros are 0; NaN has no key."""
    size = F.abs(value)
    bounded = F.least(size, F.lit(1.7976931348623157e308))
    # the logarithm can be off by one next to a power of two
    guess = F.floor(F.log2(bounded)).cast("double")
    power = F.pow(F.lit(2.0), guess)
    exponent = guess - (bounded < power).cast("double") + (bounded / 2 >= power).cast("double")
    mantissa = bounded / F.pow(F.lit(2.0), exponent) - 1
    normal = ((exponent + 1023) * F.lit(2.0**52)).cast("bigint") + (mantissa * F.lit(2.0**52)).cast("bigint")
    bits = (
        F.when(size == 0, F.lit(0).cast("bigint"))
        .when(size == float("inf"), F.lit(2047 << 52))
        .when(size < 2.0**-1022, (size * F.lit(2.0**537) * F.lit(2.0**537)).cast("bigint"))
        .otherwise(normal)
    )
    return F.when(value < 0, -bits).otherwise(bits)


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    column: str,
    statistics: Mapping[str, Statistic],
    exact_rows: int = EXACT_ROWS,
) -> DataFrame:
    """One row per group: the keys, ``n`` (values present) and each named statistic."""
    if not keys:
        whole = order_statistics(df.withColumn("__all", F.lit(0)), ["__all"], column, statistics, exact_rows)
        return whole.drop("__all")
    value = F.col(column).cast("double")
    # one column names the group: nulls inside a struct are equal to each other
    rows = df.select(F.struct(*keys).alias("g"), value.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.agg(F.max("n").alias("n")).first()["n"] or 0
    if largest <= exact_rows:
        return _named(_sorted_groups(rows, statistics), keys, statistics)
    sizes = pinned(sizes)
    large = _sent(sizes.filter(F.col("n") > exact_rows))
    small = rows.join(large, "g", "left_anti")
    every = _sorted_groups(small, statistics).unionByName(_selected(rows, large, statistics, exact_rows))
    return _named(every, keys, statistics)


def _sent(df: DataFrame) -> DataFrame:
    """To every task if it is measured to be small."""
    return F.broadcast(df) if broadcastable(df) else df


def _named(found: DataFrame, keys: Sequence[str], statistics: Mapping[str, Statistic]) -> DataFrame:
    return found.select(*[F.col("g")[k].alias(k) for k in keys], "n", *statistics)


def _sorted_groups(rows: DataFrame, statistics: Mapping[str, Statistic]) -> DataFrame:
    arrays = rows.groupBy("g").agg(F.sort_array(F.collect_list("v")).alias("a"))
    arrays = arrays.withColumn("n", F.size("a").cast("bigint"))
    at = {
        name: (F.get("a", low(F.col("n")).cast("int")) + F.get("a", high(F.col("n")).cast("int"))) / 2
        for name, (_, low, high) in statistics.items()
    }
    return arrays.select("g", "n", *[c.alias(name) for name, c in at.items()])


def _selected(rows: DataFrame, large: DataFrame, statistics: Mapping[str, Statistic], exact_rows: int) -> DataFrame:
    """The statistics of the groups of ``large`` (g, n) by radix selection."""
    wanted = [
        F.struct(F.lit(f"{side}_{name}").alias("target"), rank(F.col("n")).cast("bigint").alias("rank"))
        for name, (_, low, high) in statistics.items()
        for side, rank in (("low", low), ("high", high))
    ]
    asked = large.select("g", "n", F.explode(F.array(*wanted)).alias("w"), F.lit(0).cast("bigint").alias("prefix"))
    asked = asked.select("g", "n", "w.target", "w.rank", "prefix")
    keyed = rows.withColumn("key", order_key(F.col("v")))
    found, bits = [], 0
    while True:
        before, bits = bits, min(64, bits + DIGIT)
        settled, asked = _narrowed(keyed, asked, before, bits, exact_rows)
        found.append(settled)
        if bits == 64 or asked.isEmpty():
            break
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    ends = every.groupBy("g", "n").pivot("target", [f"{s}_{n}" for n in statistics for s in ("low", "high")]).agg(F.first("v"))
    return ends.select("g", "n", *[((F.col(f"low_{s}") + F.col(f"high_{s}")) / 2).alias(s) for s in statistics])


def _narrowed(
    keyed: DataFrame, asked: DataFrame, before: int, bits: int, exact_rows: int
) -> tuple[DataFrame, DataFrame]:
    """One round: (ranks that are settled, with their value; ranks that go on with a longer prefix)."""

    def prefix(length: int) -> Column:
        return F.shiftright("key", 64 - length) if length else F.lit(0).cast("bigint")

    places = _sent(asked.select("g", "prefix").distinct())
    inside = keyed.withColumn("prefix", prefix(before)).join(places, ["g", "prefix"])
    counts = inside.groupBy("g", "prefix", prefix(bits).alias("longer")).agg(
        F.count(F.lit(1)).alias("c"), F.min("v").alias("low"), F.max("v").alias("high")
    )
    digits = counts.groupBy("g", "prefix").agg(F.sort_array(F.collect_list(F.struct("longer", "c", "low", "high"))).alias("d"))
    start = F.struct(
        F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast(digits.schema["d"].dataType.elementType).alias("in")
    )

    def step(state: Column, digit: Column) -> Column:
        reached = state["in"].isNull() & (state["seen"] + digit["c"] > F.col("rank"))
        return F.struct(
            F.when(state["in"].isNotNull() | reached, state["seen"]).otherwise(state["seen"] + digit["c"]).alias("seen"),
            F.when(state["in"].isNotNull(), state["in"]).when(reached, digit).alias("in"),
        )

    joined = asked.join(digits, ["g", "prefix"]).withColumn("s", F.aggregate("d", start, step))
    went = pinned(joined.select(
        "g", "n", "target", (F.col("rank") - F.col("s.seen")).alias("rank"), F.col("s.in.longer").alias("prefix"),
        F.col("s.in.c").alias("c"), F.col("s.in.low").alias("low"), F.col("s.in.high").alias("high"),
    ))
    single = (F.col("low") == F.col("high")) | F.lit(bits == 64)
    settled = went.filter(single).select("g", "n", "target", F.col("low").alias("v"))
    few = went.filter(~single & (F.col("c") <= exact_rows))
    held = _sent(few.select("g", "prefix").distinct())
    arrays = keyed.withColumn("prefix", prefix(bits)).join(held, ["g", "prefix"])
    arrays = arrays.groupBy("g", "prefix").agg(F.sort_array(F.collect_list("v")).alias("a"))
    picked = few.join(arrays, ["g", "prefix"]).select(
        "g", "n", "target", F.get("a", F.col("rank").cast("int")).alias("v")
    )
    onward = went.filter(~single & (F.col("c") > exact_rows)).select("g", "n", "target", "rank", "prefix")
    return settled.unionByName(picked), onward
