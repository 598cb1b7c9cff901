"""Whole training sets, bounded memory and cheap counts of the training-text operators."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from parity.llm import decontaminate, language, pieces, tokens

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

public_tokenizers = pytest.importorskip("public_tokenizers")


def _texts(spark, n):
    words = "the house stands near river and bread lies upon table while people walk".split()
    rows = [(i, " ".join(words[(i * k + k) % len(words)] for k in range(1, 4 + i % 7)), "en" if i % 3 else "de") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), rows


def test_language_is_learned_from_every_document(spark):
    docs, rows = _texts(spark, 9000)
    model = language.train(docs, held_out=F.lit(False))
    n = np.array([sum(r[2] == x for r in rows) for x in model.languages])
    assert n.max() > 5000
    assert np.allclose(model.prior, np.log(n / n.sum()), rtol=0, atol=1e-12)


def test_language_floors_are_ranks_of_every_document(spark):
    docs, rows = _texts(spark, 12_000)
    docs = docs.withColumn("lang", F.lit("en"))
    model = language.train(docs, held_out=F.lit(False))
    _, mean, _ = language.means([r[1] for r in rows], model)
    mean = np.sort(mean)
    middle, low = mean[-(-len(mean) // 2) - 1], mean[-(-len(mean) // 100) - 1]
    wanted = middle - max(language.RANGE * (middle - low), language.ROOM)
    assert language.floors(docs, model, "doc_id", "text", "lang") == pytest.approx([wanted], abs=1e-12)


def test_word_counts_by_splitting(spark):
    texts = [None, "", " ", "-- ;", "a", " a", "a ", "Don't STOP 12ab", "é--ü x", "😀".encode("utf-16", "surrogatepass").decode("utf-16") + " z",
             "\0a\0\nb\t", "@A[Z`a{z\x7f\x80", "word " * 30_000, "-" * 50_000, "x" * 50_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.n for r in df.select("i", decontaminate.n_words_of(F.col("text")).alias("n")).collect()}
    assert got == {i: len(re.findall(WORD, t or "")) for i, t in enumerate(texts)}
    report = decontaminate.report(df, df.limit(0), "i", item_id="i")
    assert "regexp_count" not in report._jdf.queryExecution().optimizedPlan().toString()
    assert {r.i: r.n_words for r in report.collect()} == got


def test_a_smaller_memory_of_pieces_gives_the_same_ids(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(300))) for i in range(40)], "doc_id bigint, text string")
    whole = sorted(tuple(r) for r in tokens.encoded(docs, path).collect())
    assert sorted(tuple(r) for r in tokens.encoded(docs, path, kept_bytes=20_000).collect()) == whole
    model = pieces.encoder(path, 20_000)
    for i in range(20):
        model.encode([" ".join(f"v{i}y{k}" for k in range(100))])
        assert model.bytes < 20_000 + 100 * 300
