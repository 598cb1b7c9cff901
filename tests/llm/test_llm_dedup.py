"""Substring deduplication and the Jaccard join against brute force."""

import hashlib
import random

import llm_data as data
import numpy as np
import pytest
from pyspark.sql import functions as F

from parity.llm import components, forest, recompression, repeats, suffixes, words


def nasty(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(40):
        n = rng.choice([0, 1, 34, 35, 36, 80, 200])
        kind = rng.random()
        if kind < 0.25:
            unit = ["run"] * n
        elif kind < 0.5:
            unit = [rng.choice("ab") for _ in range(n)]
        elif kind < 0.6:
            unit = ["abc"[j % 3] for j in range(n)]
        else:
            unit = [str(rng.randrange(10**6)) for _ in range(n)]
        rows.append((i, " ".join(unit)))
    for i in range(40, 90):
        source = rng.choice(rows[:40])[1].split()
        a = rng.randrange(max(1, len(source)))
        middle = source[a : a + rng.randrange(20, 90)]
        ends = [[str(rng.randrange(10**6)) for _ in range(rng.randrange(30))] for _ in range(2)]
        rows.append((i, " ".join(ends[0] + middle + ends[1])))
    return rows


@pytest.mark.parametrize("rows", [data.awkward(), nasty(3), nasty(4)], ids=["awkward", "nasty3", "nasty4"])
def test_repeated_words_go(spark, rows):
    got = recompression.deduplicated(data.frame(spark, rows).repartition(3)).collect()
    got = data.counted((r.doc_id, r.n_words, r.n_removed, recompression.digest(r.kept)) for r in got)
    want = data.windows_removed(rows, 35, lambda t: t.encode().split(), b" ".join)
    assert got == data.counted((i, n, gone, sha) for (i, _), (n, gone, _, sha) in zip(rows, want, strict=True))


@pytest.mark.parametrize("crowd", [4096, 1])
@pytest.mark.parametrize("rows", [data.awkward(), nasty(5)], ids=["awkward", "nasty5"])
def test_repeated_bytes_go(spark, rows, crowd):
    rows = [(i, t and t[:4000]) for i, t in rows]
    got = suffixes.deduplicated(data.frame(spark, rows).repartition(3), crowd=crowd).collect()
    got = data.counted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got)
    want = data.windows_removed(rows, 200, lambda t: list(t.encode()), bytes)
    assert got == data.counted((i, *w) for (i, _), w in zip(rows, want, strict=True))


def test_empty_tables_stay_empty(spark):
    none = data.frame(spark, [])
    assert recompression.deduplicated(none).count() == 0
    assert suffixes.deduplicated(none).count() == 0
    assert forest.classes(none).count() == 0
    assert forest.one_of_each(none).count() == 0


def test_equal_passages_have_equal_inner_symbols():
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 40, 300).astype(np.uint64)
    a = np.concatenate([rng.integers(0, 40, 50).astype(np.uint64), passage, rng.integers(0, 40, 50).astype(np.uint64)])
    b = np.concatenate([rng.integers(0, 40, 9).astype(np.uint64), passage, rng.integers(0, 40, 70).astype(np.uint64)])

    def inside(values, start):
        symbols, first, left, right = recompression.recompress(values, np.zeros(len(values), np.int64))
        keep = (left >= start) & (right <= start + 300)
        return list(zip(symbols[keep], (first - start)[keep], (left - start)[keep], (right - start)[keep], strict=True))

    assert inside(a, 50) == inside(b, 9) and len(inside(a, 50)) > 50


def test_cover_gives_every_difference():
    for period in (7, 31, 64):
        cover = suffixes.difference_cover(period)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_smallest_of_sliding_windows():
    values = np.random.default_rng(2).integers(0, 1000, 500).astype(np.uint64)
    want = [values[i : i + 37].min() for i in range(500 - 36)]
    assert suffixes.sliding_smallest(values, 37).tolist() == want


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_classes(spark, seed):
    rng = random.Random(seed)
    rows = data.awkward(seed)[:-6]
    rows = [(i, t and t[:3000]) for i, t in rows]
    for g in range(6):
        base = data.prose(rng, rng.choice([6, 60, 200])).split()
        for k in range(rng.choice([2, 5, 12])):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 60)):
                text[rng.randrange(len(text))] = f"new{rng.randrange(1000)}"
            rows.append((100 * g + 100 + k, " ".join(text)))
    got = forest.classes(data.frame(spark, rows).repartition(3)).collect()
    got = data.counted((r.id, r.class_id, r.n_links, r.n_class) for r in got)
    assert got == data.counted((i, *c) for (i, _), c in zip(rows, data.jaccard_classes(rows), strict=True))


def test_small_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(9)
    base = data.prose(rng, 150).split()
    rows = []
    for i in range(40):
        text = list(base)
        text[rng.randrange(150)] = f"new{i}"
        rows.append((i, " ".join(text)))
    want = data.counted((i, *c) for (i, _), c in zip(rows, data.jaccard_classes(rows), strict=True))
    monkeypatch.setattr(forest, "BLOCK", 7)
    got = forest.classes(data.frame(spark, rows)).collect()
    assert data.counted((r.id, r.class_id, r.n_links, r.n_class) for r in got) == want


def test_one_of_each_class_stays(spark):
    rows = data.awkward()
    classes = data.jaccard_classes(rows)
    kept = forest.one_of_each(data.frame(spark, rows))
    assert kept.columns == data.frame(spark, rows).columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    full = {(i, t) for i, t in rows if data.shingles(t)}
    named = {r: c for r, c in zip(rows, classes, strict=True)}
    assert sum(not data.shingles(t) for _, t in got) == sum(not data.shingles(t) for _, t in rows)
    with_words = [r for r in got if data.shingles(r[1])]
    assert len(with_words) == len(set(with_words)) and set(with_words) <= full
    assert {named[r][0] for r in with_words if r[0] is not None} == {c[0] for r, c in named.items() if data.shingles(r[1]) and c[0] is not None}



def test_depth_meets_the_recall():
    depth = forest.depth_for(24, 6, 0.8, 1 - 1e-7)
    assert 1 - (1 - 0.8**depth) ** 24 >= 1 - 1e-7 > 1 - (1 - 0.8 ** (depth + 1)) ** 24
    with pytest.raises(ValueError):
        forest.depth_for(1, 6, 0.8, 0.999)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(21)}, **{i: 100 for i in range(100, 140)}}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_word_hashes_depend_on_the_words_alone():
    parts = ["alpha beta".encode(), " beta\talpha\n".encode(), b"", "é beta".encode()]
    buffer, starts, ends, first = words.word_bounds(parts)
    h = words.word_hashes(buffer, starts, ends)
    assert first.tolist() == [0, 2, 4, 4, 6]
    assert h[0] == h[3] and h[1] == h[2] == h[5] and len(set(h.tolist())) == 3


def test_large_ids_beside_null_ones_lose_no_document(spark):
    ids = [2**53 + 1, 2**53 + 3, 2**63 - 1, -(2**63), None, 7]
    texts = [data.prose(random.Random(k), 40) for k in range(len(ids))]
    rows = [*zip(ids, texts, strict=True), (2**53 + 5, texts[0])]
    docs = data.frame(spark, rows).coalesce(1)
    assert data.counted((r.id,) for r in forest.classes(docs).select("id").collect()) == data.counted((i,) for i, _ in rows)
    assert data.counted((r.doc_id,) for r in forest.one_of_each(docs).collect()) == data.counted((i,) for i in ids)
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert forest.one_of_each(named).count() == len(ids)


def test_findings_of_equal_rows_are_shared(spark):
    """Copies under one id: every row is repeated as a whole, and its findings do not grow with the copies."""
    text = " ".join(f"w{i}" for i in range(300))
    sizes = {}
    for copies in (3, 300):
        rows = repeats.rows_of(data.frame(spark, [(None, text)] * copies).repartition(5), "doc_id", "text")
        found = repeats.by_document(repeats.census(rows, recompression.anchoring(35), 4)).collect()
        assert len(found) == 1
        sizes[copies] = sum(map(len, found[0]["found"]))
    assert sizes[3] == sizes[300] > 0
    out = recompression.deduplicated(data.frame(spark, [(None, text)] * 300).repartition(5)).collect()
    assert len(out) == 300 and {r["n_removed"] for r in out} == {300}
