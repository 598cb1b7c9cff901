"""Hard negatives against every product of every pair."""

import math
import random

import pytest
from pyspark.sql import functions as F

from llm_data import CLASHING, counted
from parity.llm import lemp


def brute(rows, positives=5, negatives=3, every=5, least=50, most=95):
    live = []
    for vec, x, label in rows:
        if vec is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        live.append((vec, [math.floor(256 * v) for v in x], label))
    out = []
    for a, (anchor, q, own) in enumerate(live):
        if anchor % every:
            continue
        scored = [
            (sum(p * r for p, r in zip(q, x, strict=False)), vec, label)
            for k, (vec, x, label) in enumerate(live) if k != a
        ]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for score, positive, _ in [s for s in scored if s[2] == own][:positives]:
            fits = [s for s in scored if s[2] != own and least * score <= 100 * s[0] <= most * score]
            out += [(anchor, positive, n + 1, vec, score, s) for n, (s, vec, _) in enumerate(fits[:negatives])]
    return out


def vectors(seed, n, dim, kind):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        x = [rng.gauss(0, 0.2) for _ in range(dim)]
        if kind == "lengths":  # a few long vectors, many short ones
            x = [v * math.exp(rng.gauss(0, 1.5)) for v in x]
        if kind == "spiked":  # directions near an axis: coordinates prune
            x[rng.randrange(dim)] += 8
        if kind == "equal" and rng.random() < 0.6:
            x = [0.5] * dim
        rows.append((k, x, rng.randrange(3)))
    return rows


def mined(spark, rows, every=5, **options):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    df = df.selectExpr("*", *(f"'z' AS `{c}`" for c in CLASHING if c != "vec_id"))
    return lemp.mined(df, F.col("vec_id") % every == 0, **options)


def as_floats(rows):
    import numpy as np

    return [(v, None if x is None else [None if c is None else float(np.float32(c)) for c in x], y) for v, x, y in rows]


@pytest.mark.parametrize("kind", ["plain", "lengths", "spiked", "equal"])
def test_negatives_are_those_of_all_products(spark, kind, monkeypatch):
    monkeypatch.setattr(lemp, "ROWS", 40)
    monkeypatch.setattr(lemp, "LEAST_ROWS", 8)
    monkeypatch.setattr(lemp, "SEED", 3)
    rows = as_floats(vectors(7, 300, 6, kind))
    assert counted(mined(spark, rows).collect()) == counted(brute(rows))


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = as_floats(vectors(3, 60, 4, "plain"))
    rows += [(5, rows[5][1], 1), (5, rows[5][1], 1), (10, [0.1], 2), (15, [], 0), (20, [0.0] * 4, 1), (200, [1.0] * 9, 1)]
    rows += [(25, None, 1), (30, [1.0, None], 1), (35, [nan], 1), (40, [inf, 1.0], 2), (45, [1.0, 2.0], None)]
    rows += [(None, [1.0, 1.0], 1), (205, [100.0, -100.0, 70.0, 3.0], 2), (206, [100.0, -100.0, 70.0, 3.5], 1)]
    assert counted(mined(spark, rows).collect()) == counted(brute(rows))


def test_large_numbers_stay_exact(spark):
    rng = random.Random(1)
    rows = [(k, [float(rng.randrange(2**18)) for _ in range(4)], k % 2) for k in range(40)]
    rows += [(100, [2.0**30] * 2, 1)]  # too long: takes no part
    assert counted(mined(spark, rows).collect()) == counted(brute(rows[:40]))


def test_empty_and_refused(spark):
    assert mined(spark, []).count() == 0
    assert mined(spark, [(1, [1.0], 1)]).count() == 0
    with pytest.raises(ValueError):
        lemp.mined(spark.createDataFrame([("a", [1.0], 1)], "vec_id string, embedding array<float>, label int"), F.lit(True))


def test_coordinates_prune_and_lose_nothing():
    """On spiked directions the ranges leave few rows, and every row that reaches the need is among them."""
    import numpy as np
    import pyarrow as pa

    rows = vectors(11, 400, 16, "spiked")
    numbers = [np.floor(256 * np.array(x)).astype(np.int64) for _, x, _ in rows]
    packed = sorted(((float(np.sqrt((x * x).sum())), k, 0, False, x) for k, x in enumerate(numbers)), reverse=True)
    bucket = lemp.Bucket(lemp.packed(0, packed).to_pylist()[0])
    query = pa.RecordBatch.from_pylist(
        [{"query": k, "own": -1, "label": 1, "numbers": x.tobytes(), "low": int(0.8 * (x * x).sum()), "high": 2**62}
         for k, x in enumerate(numbers[:50])]
    )
    block = lemp.Block(query, 3)
    share, ranges = block.ranges(bucket, np.arange(50), block.need(), 16)
    for k in range(50):
        inside = block.inside(bucket, ranges[k], {})
        reached = np.flatnonzero(bucket.numbers @ numbers[k] >= block.low[k])
        assert set(reached) <= set(inside)
    assert np.median(share) < 0.3
