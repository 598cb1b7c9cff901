"""Token files, mixing and the pipeline."""

import random
import zlib

import corpus_pipeline
import llm_data as data
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parity.llm import mixture, pieces, tokens
from parity.llm.files import publish, scratch_uri
from parity.llm.registry import prepared

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_pieces_give_the_ids_of_whole_texts(spark, tokenizer):
    texts = ["", " ", "a", " a", "a ", "a  b", "a\n\nb", "a\n b", "a \nb", "a\tb c", "x<|endoftext|>y z", "it's the 's dog's 12 b'",
             "é ü  x", "a\x01b", "\x01a b", "a　 　b", "a\x1cb \x1c c", "a\u0085b", "a\rd e", "don't. x", "a_, b__", "a² b²,",
             "é, f.,;: (g) 're've", "\n", "a\n", "naïve, œuvre. 日本語 です。 x", "a.b.c 3.14, --- ... !?"]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    model = pieces.PieceEncoder(PATH)
    for end in (None, 2):
        ids, n = model.encode(texts, end)
        want = [e.ids + ([] if end is None else [end]) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert n.tolist() == list(map(len, want))
        assert ids.tolist() == [x for w in want for x in w]


def test_rare_pieces_are_forgotten_and_learned_again(spark, tokenizer, monkeypatch):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] * 2
    monkeypatch.setattr(pieces, "KEPT_BYTES", 500 * 250)
    model = pieces.PieceEncoder(PATH)
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for k in range(0, len(texts), 7):
        ids, n = model.encode(texts[k : k + 7])
        assert ids.tolist() == [x for w in want[k : k + 7] for x in w] and n.tolist() == list(map(len, want[k : k + 7]))
    assert len(model.index) < 20000


def test_files_give_back_every_document(spark, tokenizer):
    rows = [(i, t and t[:2000]) for i, t in data.awkward()] + [(-5, "below zero"), (2**62, "far")]
    docs = data.frame(spark, rows).repartition(3)
    folder = scratch_uri(spark, "tokens")
    shards = tokens.write_shards(docs, folder, PATH, shard_bytes=3000)
    assert shards.count() > 2
    got = tokens.read_documents(shards).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got[:-1]]).tolist()

    def seen(text):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        return len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())

    assert data.counted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == data.counted((i, *seen(t)) for i, t in rows)
    wanted = spark.createDataFrame([(k,) for k in (-5, 1, 2, 3, 999, 2**62, 2)], "k bigint")
    found = {r.k: r.ids for r in tokens.lookup(shards, wanted, "k").collect()}
    assert set(found) == {-5, 1, 2, 3, 2**62}
    for k, ids in found.items():
        own = [t for i, t in rows if i == k]
        assert len(ids) == sum(seen(t)[0] for t in own)
        if len(own) == 1:
            assert ids == tokenizer.encode(own[0] or "", add_special_tokens=False).ids + [2]


def test_four_byte_ids_and_empty_tables(spark):
    docs = data.frame(spark, [(1, "some words"), (2, None)])
    a, b = (tokens.encoded(docs, PATH, width=w).collect() for w in (2, 4))
    assert data.counted(a) == data.counted(b)
    assert tokens.encoded(docs.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        tokens.encoded(docs, PATH, width=3)


def test_large_ids_beside_null_ones_stay_what_they_are(spark):
    ids = [2**53 + 1, 2**53 + 3, 2**63 - 1, -(2**63), -(2**63) + 1, 0, None, None]
    docs = data.frame(spark, [(i, f"text of {k}") for k, i in enumerate(ids)]).coalesce(1)
    found = [r.doc_id for r in tokens.encoded(docs, PATH).orderBy("start").collect()]
    assert found == [None, None, *sorted(i for i in ids if i is not None)]
    with pytest.raises(ValueError):
        tokens.encoded(docs.withColumn("doc_id", F.col("doc_id").cast("string")), PATH)


def test_a_broken_index_is_not_read(spark):
    keys, lengths = np.arange(50, dtype=np.int64), np.ones(50, np.int64)
    good = tokens.index_bytes(keys, lengths, 2, 0)
    at = tokens.HEADER.size + 3 * 8 * 50
    for data_bytes, broken in ((good, False), (good[:at] + b"\1\0\0\0" * 13 + good[at + 52 :], True)):
        uri = scratch_uri(spark, "index")
        for name, content in (("idx", data_bytes), ("ids", b"\0" * 100)):
            publish(f"{uri}.{name}", "part", lambda stream, content=content: stream.write(content))
        shard = tokens.Shard(uri)
        if broken:
            with pytest.raises(ValueError):
                list(shard.documents())
        else:
            assert len(list(shard.documents())) == 50


@pytest.mark.parametrize("n", [0, 1, 2, 5, 100, 3000])
def test_perfect_hash_is_minimal(n):
    keys = np.unique(np.random.default_rng(n).integers(-(2**62), 2**62, n))
    _, slots = tokens.perfect_hash(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))


# ---- mixing


def weighted(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        source = rng.choice(["a"] * 6 + ["b", "b", "c", None])
        rows.append((i, data.prose(rng, rng.randrange(1, 80)) + rng.choice(["", " License", " @"]), source, rng.choice(["en", "en", "de", None])))
    rows += [(500, None, "a", "en"), (501, "", "only", "xx"), (0, rows[0][1], rows[0][2], rows[0][3])]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string").selectExpr(
        "*", "1 AS topic", "2 AS tokens", "'z' AS _source", "'z' AS _p", "1 AS weight", "2 AS key"
    )


def test_raking_meets_its_targets(spark):
    docs = weighted(spark)
    targets = {"source": {"a": 0.25, "b": 0.25, "c": 0.25, mixture.NULL: 0.25}, "lang": {"en": 0.5, "de": 0.3, mixture.NULL: 0.2}}
    cells = mixture.probabilities(mixture.features(docs, "doc_id", "text", "source", "lang"), targets, budget=0.3).toPandas()
    for dim in mixture.DIMENSIONS:
        sums = cells.groupby(dim).agg(w=("weight", "sum"), t=(f"target_{dim}", "first"))
        assert np.allclose(sums.w, sums.t, atol=1e-5)
    w = cells.tokens / cells.tokens.sum()
    for _ in range(500):
        for dim in mixture.DIMENSIONS:
            w = w * cells[f"target_{dim}"] / w.groupby(cells[dim]).transform("sum")
    assert np.allclose(w, cells.weight, atol=1e-5)
    assert abs((cells.tokens * cells.probability).sum() - 0.3 * cells.tokens.sum()) < 1e-3 * cells.tokens.sum() or (cells.probability == 1).any()
    assert cells.probability.between(0, 1).all()


@pytest.mark.parametrize("few", [True, False])
def test_sampling_follows_the_probabilities(spark, monkeypatch, few):
    docs = weighted(spark)
    if not few:
        monkeypatch.setattr(mixture, "BROADCAST_CELLS", 0)
    report = mixture.report(docs, budget=0.4).collect()
    assert len(report) == docs.count()
    kept = mixture.mixed(docs, budget=0.4)
    assert kept.columns == docs.columns
    assert data.counted((r.doc_id,) for r in kept.collect()) == data.counted((r.id,) for r in report if r.sampled)
    share = sum(r.n_tokens for r in report if r.sampled) / sum(r.n_tokens for r in report)
    assert 0.3 < share < 0.5
    assert mixture.mixed(docs, budget=0.4).exceptAll(kept).count() == 0
    assert all(r.probability == 0 and not r.sampled for r in report if r.id == 501)


def test_everything_stays_at_full_budget(spark):
    report = mixture.report(weighted(spark), powers={}, budget=1.0).collect()
    assert all(r.sampled for r in report if r.n_tokens)
    assert mixture.report(weighted(spark).limit(0)).count() == 0


# ---- the pipeline


def test_pipeline_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(90001, None, "en", "s", 0), (90002, "12345 !!", "en", "s", 8)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    stages = dict(corpus_pipeline.STAGES)
    one = stages["language"](spark, docs, SF).cache()
    assert one.columns == docs.columns
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in one.collect()} == {90001, 90002}
    rows = [(r.doc_id, r.text) for r in one.orderBy("doc_id").collect()]
    firsts = {c for c, _, _ in data.jaccard_classes(rows)}
    two = stages["near_copies"](spark, one, SF).cache()
    assert sorted(r.doc_id for r in two.collect()) == sorted(firsts)
    three = stages["benchmark"](spark, two, SF).cache()
    from test_llm_text import contaminated

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [r[0] for r in contaminated([(r.doc_id, r.text) for r in two.collect()], items).elements() if not r[5]]
    assert sorted(r.doc_id for r in three.collect()) == sorted(clean) and len(clean) < two.count()
    four = stages["mixture"](spark, three, SF).cache()
    tokens_of = lambda df: df.select(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0]
    assert 0.8 < tokens_of(four) / tokens_of(three) < 0.99 and four.exceptAll(three).count() == 0
    five = stages["token_ids"](spark, four, SF).collect()
    assert sorted(r.doc_id for r in five) == sorted(r.doc_id for r in four.collect())


def test_pipeline_runs_whole(spark):
    run = prepared(corpus_pipeline.run)(spark, SF)
    assert run.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and run.count() > 100
