"""The alignment of two tokenizers against whole texts encoded and compared byte by byte."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from llm_data import awkward, counted, frame, prose
from parity.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    (100, "  two  spaces \n\n and\tmore   x　y "), (101, "漢字かな 😀😀 𝔘nicode é ﬁ"),
    (102, "holds ▁ the mark"), (103, "<|endoftext|> <s> </s> <unk> <0x41> <pad>"), (104, "\nline\nline \n"),
    (105, "a\x00b \x01 \x7f \x85 ​﻿"), (106, " "), (107, "\n"), (108, "don't we'll I'm  'tis"),
    (109, "x" * 5000), (110, " y" * 300), (111, "ééé\nñandú 12345 1,000.5 ==== ----"), (112, "a b  c"),
]


def brute(rows):
    """(doc_id, figures, digest) of each row and the pair counts, from whole texts."""
    model = alignment.Aligner(A, B)
    encoded = []
    for _, text in rows:
        text = text or ""
        full = f" {text}".encode()
        a = model.a.encode(f" {text}", add_special_tokens=False).ids
        b = model.b.encode(text)
        joined = [b"".join(t[i] for i in ids) for ids, t in ((a, model.a_bytes), (b, model.b_bytes))]
        if not text or joined != [full, full]:
            encoded.append(None)
            continue
        owner = []
        for ids, t in ((a, model.a_bytes), (b, model.b_bytes)):
            owner.append([k for k, i in enumerate(ids) for _ in t[i]])
        links = sorted(set(zip(*owner, strict=True)))
        groups, at, first = [], 0, (0, 0)
        for at in range(1, len(full) + 1):
            ends = [at == len(full) or o[at] != o[at - 1] for o in owner]
            if all(ends):
                last = (owner[0][at - 1] + 1, owner[1][at - 1] + 1)
                groups.append("|".join(",".join(map(str, ids[x:y])) for ids, x, y in zip((a, b), first, last, strict=True)))
                first = last
        encoded.append((a, b, groups, [(a[i], b[j]) for i, j in links]))
    counts = Counter(p for e in encoded if e for p in e[3])
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    out = []
    for (doc, _), e in zip(rows, encoded, strict=True):
        if e is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = e
        best = sum(counts[p] == most[p[1]] for p in links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((doc, len(a), len(b), len(groups), len(links), best, sum(counts[p] for p in links), digest))
    return out, counts


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 20, 0])
def test_alignment_is_that_of_whole_texts(spark, frequent):
    rows = awkward() + ODD
    documents, pairs = alignment.aligned(frame(spark, rows), A, B, frequent=frequent)
    expected, counts = brute(rows)
    assert counted(documents.collect()) == counted(expected)
    assert {(r.a_id, r.b_id): r.links for r in pairs.collect()} == dict(counts)


def test_units_found_before_and_forgotten_give_the_same(spark, monkeypatch):
    import pyarrow as pa

    rng = random.Random(5)
    rows = [(k, prose(rng, 60)) for k in range(40)] + ODD
    monkeypatch.setattr(alignment, "KEPT_BYTES", 20_000)
    model = alignment.Aligner(A, B)
    expected, _ = brute(rows)
    for _ in range(3):
        for k, (_, text) in enumerate(rows):
            out = alignment.aligned_texts(model, pa.array([text]))
            assert (*out["sums"][0].tolist(), out["digests"][0]) == (*expected[k][1:5], expected[k][7])


def test_an_empty_table_and_ids_of_any_type(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert [d.count() for d in alignment.aligned(empty, A, B)] == [0, 0]
    named = spark.createDataFrame([("a", "one two"), (None, "x")], "doc_id string, text string")
    assert {r.doc_id: r.n_links for r in alignment.aligned(named, A, B)[0].collect()}["a"] >= 2
    large = [(2**53 + 1, "one"), (-(2**63), "two"), (2**63 - 1, "three"), (None, None)]
    out = alignment.aligned(frame(spark, large), A, B)[0]
    assert {r.doc_id for r in out.collect()} == {i for i, _ in large}
