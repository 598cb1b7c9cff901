"""The corpus pipeline: documents in, the ids of the kept ones out, one operator of ``parity.llm`` a stage.

Every stage works on all that the one before it kept. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from parity.llm import decontaminate, forest, language, mixture, tokens
from parity.llm.registry import prepared, table
from parity.session import scratch_path

#: The share of tokens that the mixture keeps.
BUDGET = 0.9
#: Documents under this probability of their language are rejected.
LEAST_SCORE = 0.5
#: What a worker remembers of pieces: the workers of the stages before are still there, and each comes to encode.
KEPT_BYTES = 32 << 20


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted(docs, least=LEAST_SCORE)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return forest.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture.mixed(docs, budget=BUDGET)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.encoded(docs, public_tokenizers.path("byte_bpe_50k.json"), kept_bytes=KEPT_BYTES)


STAGES = [
    (name, prepared(stage))
    for name, stage in (
        ("language", known_language),
        ("near_copies", without_near_copies),
        ("benchmark", without_benchmark),
        ("mixture", to_target_weights),
        ("token_ids", token_ids),
    )
]

#: Models, sketches and files are not SQL: the tests hold run() against brute-force versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
