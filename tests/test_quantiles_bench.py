import random
import struct
import statistics

import pytest
from pyspark.sql import functions as F

from parity.operators import bench
from parity.operators.quantiles import EXACT_ROWS, MEDIAN, P75, order_key, order_statistics


def p75(values):
    ordered = sorted(values)
    return ordered[round(0.75 * (len(ordered) - 1))]


def noise(values):
    m = statistics.median(values)
    return 1.4826 * statistics.median(abs(v - m) for v in values) / m if len(values) > 1 and m > 0 else 0.0


def test_small_groups_of_every_size(spark):
    rng = random.Random(3)
    groups = {n: [rng.choice([rng.random(), 0.5]) for _ in range(n)] for n in range(1, 40)}
    df = spark.createDataFrame([(n, v) for n, vs in groups.items() for v in vs], "g int, v double")
    for row in order_statistics(df, ["g"], "v", {"m": MEDIAN, "q": P75}).collect():
        values = groups[row.g]
        assert (row.n, row.m, row.q) == (len(values), statistics.median(values), p75(values))


@pytest.mark.parametrize("shape", ["spread", "ties"])
def test_a_group_beyond_the_exact_limit_is_bracketed(spark, shape):
    n = EXACT_ROWS * 2 + 1
    mixed = F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double")
    value = mixed if shape == "spread" else F.when(F.col("id") % 3 == 0, 500_000.0).otherwise(mixed)
    df = spark.range(n).select((F.col("id") % 50 == 0).alias("g"), value.alias("v")).cache()
    got = {r.g: (r.n, r.m, r.q) for r in order_statistics(df, ["g"], "v", {"m": MEDIAN, "q": P75}).collect()}
    for g in (True, False):
        values = [r.v for r in df.filter(F.col("g") == g).select("v").collect()]
        assert got[g] == (len(values), statistics.median(values), p75(values))


def test_without_keys_and_with_missing_values(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (4.0,)], "v double")
    row = order_statistics(df, [], "v", {"m": MEDIAN}).first()
    assert (row.n, row.m) == (2, 2.5)


RUNS = {
    "a": [10, 10, 12, 20],
    "b": [10.0, 10.1, 9.9, 10.0],
    "c": [9.556, 10.736, 20.208, 10.331, 9.641, 9.667, 10.122, 10.64],
    "d": [2, 5, 5, 12],
    "e": [10, 10, 10, 20],
    "f": [10, 20, 20, 20],
    "one": [7.0],
}


@pytest.fixture(scope="module")
def runs(spark):
    rows = [(k, float(v), False, False) for k, vs in RUNS.items() for v in vs]
    rows += [(k, 1000.0, True, False) for k in RUNS]
    rows += [("empty", 5.0, True, True)]
    return spark.createDataFrame(rows, "config string, duration double, is_warmup boolean, failed boolean")


def test_bench_stats(runs):
    got = {r.config: r for r in bench.bench_stats(runs, ["config"]).collect()}
    for name, values in RUNS.items():
        row = got[name]
        assert (row.samples, row.median, row.p75) == (len(values), statistics.median(values), p75(values))
        assert row.noise_ratio == pytest.approx(noise(values))
        m = statistics.median(values)
        assert row.outliers == sum(abs(v - m) > 0.5 * m for v in values)
    assert (got["a"].median, got["a"].p75) == (11, 12)
    assert got["b"].noise_ratio < 0.02 and got["c"].noise_ratio < 0.25 < got["d"].noise_ratio
    assert got["c"].outliers == 1 and got["e"].noise_ratio == 0 and got["f"].p75 == 20
    assert (got["empty"].median, got["empty"].p75, got["empty"].noise_ratio, got["empty"].failed) == (0, 0, 0, True)


def compared(spark, base, cand, failed=False):
    rows = [("base", float(v), False) for v in base] + [("cand", float(v), failed) for v in cand]
    df = spark.createDataFrame(rows, "config string, duration double, failed boolean")
    return bench.bench_compare(bench.bench_stats(df, ["config"]), "config", "base")


@pytest.mark.parametrize(
    ("base", "cand", "inconclusive", "robust", "improved"),
    [
        ([12.0] * 4, [6.0] * 4, False, True, True),
        ([10.0], [5.0], True, True, False),
        ([10.0] * 4, [7.9, 8.1, 10.0, 10.2], False, False, False),
        ([12, 12.1, 11.9, 12], [9, 9.1, 8.9, 9], False, True, True),
        ([2, 5, 5, 12], [1, 1, 1, 1], True, True, False),
        ([10.0] * 4, [9.5] * 4, False, True, False),
    ],
)
def test_comparisons(spark, base, cand, inconclusive, robust, improved):
    row = compared(spark, base, cand).first()
    assert row.speedup == pytest.approx(statistics.median(base) / statistics.median(cand))
    assert (row.inconclusive, row.robust, row.improved) == (inconclusive, robust, improved)
    arrays = spark.createDataFrame(
        [([float(v) for v in base], [float(v) for v in cand])], "b array<double>, c array<double>"
    ).select(
        F.struct(
            F.lit(1.1).alias("min_speedup"), F.lit(0.25).alias("max_noise_ratio"),
            F.struct(F.col("b").alias("durations"), F.lit(False).alias("failed")).alias("baseline"),
            F.struct(F.col("c").alias("durations"), F.lit(False).alias("failed")).alias("candidate"),
        ).alias("comparison")
    )
    same = bench.judged_attempts(arrays).first()
    assert (same.inconclusive, same.robust, same.improved) == (inconclusive, robust, improved)


def test_failed_run_is_inconclusive(spark):
    assert compared(spark, [10.0] * 4, [5.0] * 4, failed=True).first().inconclusive


def test_verdicts_settle_correctness_first(spark):
    fast, slow = compared(spark, [12.0] * 4, [6.0] * 4), compared(spark, [10.0] * 4, [9.5] * 4)
    for frame, status, verdict in (
        (fast, None, "unverified"), (fast, "FAIL", "rejected_correctness"), (fast, "PASS", "accepted"),
        (slow, "PASS", "rejected_below_threshold"), (compared(spark, [10.0], [5.0]), "PASS", "rejected_inconclusive"),
        (compared(spark, [10.0] * 4, [7.9, 8.1, 10.0, 10.2]), "PASS", "rejected_not_robust"),
    ):
        row = bench.bench_verdict(frame.withColumn("s", F.lit(status).cast("string")), "s").first()
        assert (row.verdict, row.accepted) == (verdict, verdict == "accepted")


def test_first_accepted_against_a_loop(spark):
    rng = random.Random(11)
    rows, expected, kept = [], {}, {}
    for s in range(40):
        tried, stopped, kept[s] = set(), False, 1.0
        for n in range(8):
            approach, ok = rng.choice(["a", "b", "c", "no_change"]), rng.random() < 0.3
            speed = round(1 + rng.random(), 3)
            rows.append((s, n, approach, ok, speed))
            if stopped:
                out = "not_reached"
            elif approach == "no_change":
                out, stopped = "declined", True
            elif approach in tried:
                out = "refused_repeat"
            else:
                tried.add(approach)
                out = "accepted" if ok else "rejected"
                if ok:
                    stopped, kept[s] = True, speed
            expected[(s, n)] = out
    df = spark.createDataFrame(rows, "s int, n int, approach string, ok boolean, speed double")
    done = bench.first_accepted(df, "s", "n", "approach", "ok")
    assert {(r.s, r.n): r.outcome for r in done.collect()} == expected
    assert {r.s: r.kept_speedup for r in bench.kept_speedup(done, "s", "speed").collect()} == kept


ODD = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, float("inf"),
       float("-inf"), 1.0, 0.9999999999999999, 1.0000000000000002, 2.0, 1.9999999999999998, 0.1, -0.1, 3.0, 1e-310, 2.0**52,
       2.0**53 - 1, 1e100, -1e-100, 7.5e-320]


def test_keys_are_the_bits_of_the_values_in_order(spark):
    rng = random.Random(2)
    values = ODD + [rng.gauss(0, 1) * 10.0 ** rng.randrange(-320, 308) for _ in range(2000)] + [2.0**e for e in range(-1074, 1024)]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", order_key(F.col("v")).alias("k"))
    for row in df.collect():
        bits = struct.unpack("<q", struct.pack("<d", abs(row.v)))[0]
        assert row.k == (-bits if row.v < 0 else bits)


@pytest.mark.parametrize("exact_rows", [1, 7, 10_000])
def test_any_rank_of_any_data_is_selected(spark, exact_rows):
    rng = random.Random(6)
    groups = {
        "odd": [rng.choice(ODD[:6] + ODD[9:]) for _ in range(400)],
        "near": [1 + k * 2.0**-52 for k in range(150)],  # differ in their last bits only
        "equal": [3.5] * 300,
        "wide": [rng.gauss(0, 1) * 10.0 ** rng.randrange(-300, 300) for _ in range(300)],
        "one": [2.0],
        None: [float(k) for k in range(50)],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    first = (0.0, lambda n: F.lit(0), lambda n: F.lit(0))
    wanted = {"m": MEDIAN, "q": P75, "least": first}
    rows = order_statistics(df, ["g"], "v", wanted, exact_rows).collect()
    assert {r.g for r in rows} == set(groups)
    for r in rows:
        values = sorted(groups[r.g])
        assert (r.n, r.m, r.q, r.least) == (len(values), statistics.median(values), p75(values), values[0])
