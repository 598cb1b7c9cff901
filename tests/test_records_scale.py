"""How the record queries meet, write and read their rows."""

import datetime
import os

from pyspark.sql import functions as F

from parity.operators import delivery, evidence
from parity.plans import record_queries
from parity.session import apply_defaults


def test_claims_and_texts_meet_without_a_broadcast(spark):
    texts = spark.createDataFrame([("m", "It is 3x faster. All 4 checks passed."), ("n", "2 rows")], "id string, text string")
    supported = spark.createDataFrame([("m", "checks", "4"), ("n", "rows", "9")], "id string, kind string, value string")
    found = delivery.excerpts(delivery.violations(delivery.extract_claims(texts), supported), texts)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.id, r.kind, r.claimed, r.excerpt) for r in found.collect())
    assert got == [("m", "speedup", "3", "It is 3x faster."), ("n", "rows", "2", "2 rows")]


def _orders(spark, folder, n):
    day = datetime.datetime(2026, 1, 1)
    spark.createDataFrame([(k, day) for k in range(1, n + 1)], "o_orderkey bigint, o_orderdate timestamp").write.parquet(
        f"{folder}/orders.parquet"
    )


def _files(folder, end):
    return [os.path.join(at, f) for at, _, names in os.walk(folder) for f in names if f.endswith(end)]


def test_record_files_are_compressed_and_bounded(spark, tmp_path, monkeypatch):
    apply_defaults(spark)
    _orders(spark, tmp_path, 600)
    monkeypatch.setattr(record_queries, "scratch_path", lambda s, name: f"{tmp_path}/{name}")
    monkeypatch.setattr(record_queries, "_DOCUMENTS", 100, raising=False)
    for name, query, kept in (
        ("records", record_queries.scan_records, range(1, 601)),
        ("newest", record_queries.newest_records, [k for k in range(1, 601) if k % 6 >= 4]),
    ):
        got = query(spark, str(tmp_path)).collect()
        assert sorted(r.migration_id for r in got if r.readable) == sorted(f"m{k}" for k in kept if k % 50)
        assert sum(not r.readable for r in got) == sum(k % 50 == 0 for k in kept)
        files = _files(f"{tmp_path}/{name}", (".txt", ".gz"))
        # over 2,000 bytes a record as plain text
        assert sum(map(os.path.getsize, files)) < 600 * 600
        assert len(files) >= 6


def test_evidence_computes_the_attempts_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def measured(x):
        seen.add(1)
        return x

    rows = spark.createDataFrame([("a", f"m{i}", True, float(i), 1.0) for i in range(5)], "key string, migration_id string, success boolean, x double, predicted double")
    attempts = rows.select("key", "migration_id", "success", measured.asNondeterministic()("x").alias("speedup"), "predicted")
    row = evidence.evidence(attempts).first()
    assert (row.attempts, row.migrations, row.speedups, row.median_speedup, row.optimism) == (5, 5, 5, 2.0, -1.0)
    assert seen.value == 5
