import json
import os

import pandas as pd
import pytest

from frames import assert_same
from parity.operators import profile
from parity.sources import datasets, files
from parity.sources.records import scan_records


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as handle:
        handle.write(text)
    return str(path)


CSV = "id,age,name,when,ok\n7,12,pear,1999-12-31,True\n8,,NA,2001-02-03,False\n9,55,None,2010-10-10,True\n"


def test_csv_has_pandas_types(spark, tmp_path):
    path = write(f"{tmp_path}/x.csv", CSV)
    got = files.read_csv(spark, path)
    assert dict(got.dtypes) == {"id": "bigint", "age": "double", "name": "string", "when": "string", "ok": "boolean"}
    assert_same(got, pd.read_csv(path))
    typed = files.read_csv(spark, path, "id bigint, age double, name string, when string, ok boolean")
    assert_same(typed, pd.read_csv(path))


def test_naive_csv_keeps_missing_texts(spark, tmp_path):
    path = write(f"{tmp_path}/x.csv", CSV)
    assert spark.read.csv(path, header=True).filter("name = 'None'").count() == 1


def test_tsv(spark, tmp_path):
    path = write(f"{tmp_path}/x.tsv", "a\tb\n1\tx\n")
    assert_same(files.read_table(spark, path), pd.read_table(path))
    assert_same(datasets.load_dataset(spark, path), pd.read_table(path))


def test_json_lines_and_arrays(spark, tmp_path):
    lines = write(f"{tmp_path}/a.jsonl", '{"a": 1, "b": "x"}\n{"a": 2, "b": null}\n')
    array = write(f"{tmp_path}/b.json", '[{"a": 1, "b": "x"},\n {"a": 2, "b": null}]')
    expected = pd.DataFrame({"a": [1, 2], "b": ["x", None]})
    assert_same(files.read_json(spark, lines), expected)
    assert_same(files.read_json(spark, array, lines=False), expected)


def test_write_modes(spark, tmp_path):
    path = f"{tmp_path}/out"
    df = spark.range(3)
    files.to_csv(df, path)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        files.to_csv(df, path, "errorifexists")
    files.to_csv(df, path, "append")
    assert files.read_csv(spark, path, "id bigint").count() == 6
    files.to_csv(df, path)
    assert files.read_csv(spark, path, "id bigint").count() == 3
    with pytest.raises(ValueError):
        files.to_csv(df, path, "ignore")


def test_a_file_and_a_directory_of_parts_are_the_same_table(spark, tmp_path):
    one = write(f"{tmp_path}/one.csv", "k,v\na,1\nb,2\nc,3\n")
    for i, row in enumerate(("a,1", "b,2", "c,3")):
        write(f"{tmp_path}/parts/part-{i}.csv", f"k,v\n{row}\n")
    write(f"{tmp_path}/parts/_SUCCESS", "")
    assert_same(datasets.load_dataset(spark, f"{tmp_path}/parts"), pd.read_csv(one))
    assert datasets.find_dataset(spark, f"{tmp_path}/parts").format == "csv"
    with pytest.raises(datasets.DatasetError):
        datasets.load_dataset(spark, f"{tmp_path}/nothing")
    os.makedirs(f"{tmp_path}/hollow")
    with pytest.raises(datasets.DatasetError):
        datasets.load_dataset(spark, f"{tmp_path}/hollow")


def test_empty_parts_are_an_empty_table(spark, tmp_path):
    for i in range(2):
        write(f"{tmp_path}/parts/part-{i}.csv", "k,v\n")
    assert datasets.load_dataset(spark, f"{tmp_path}/parts").count() == 0


def test_profile_columns(spark, tmp_path):
    df = files.read_csv(spark, write(f"{tmp_path}/p.csv", "a,b\n1,x\n2,\n2,y\n"))
    got = {r.column: r for r in profile.profile_columns(df).collect()}
    assert (got["b"].null_count, got["b"].null_fraction) == (1, pytest.approx(1 / 3))
    assert (got["a"].distinct_count, got["a"].min_value, got["a"].max_value) == (2, "1", "2")
    assert got["b"].examples == ["x", "y"]
    schema = profile.schema_from_profile(profile.profile_columns(df))
    assert [(f.name, f.dataType.simpleString(), f.nullable) for f in schema] == [("a", "bigint", False), ("b", "string", True)]


def test_profiles_report_errors(spark, tmp_path):
    write(f"{tmp_path}/b.csv", "a\n1\n")
    write(f"{tmp_path}/a.csv", "a\n1\n2\n")
    write(f"{tmp_path}/notes.bin", "?")
    write(f"{tmp_path}/bad.parquet", "not parquet")
    rows = profile.profile_directory(spark, str(tmp_path)).collect()
    assert [os.path.basename(r.path) for r in rows] == ["a.csv", "b.csv", "bad.parquet"]
    assert [r.exists for r in rows] == [True, True, False] and rows[2].error
    assert [r.row_count for r in rows] == [2, 1, 0]
    flags = [r.broadcast_candidate for r in profile.size_report(profile.profile_directory(spark, str(tmp_path))).collect()]
    assert flags == [True, True, False]
    missing = profile.profile_dataset(spark, f"{tmp_path}/gone.csv").first()
    assert not missing.exists and missing.error
    assert profile.profile_directory(spark, f"{tmp_path}/gone").count() == 0
    sampled = profile.profile_dataset(spark, f"{tmp_path}/a.csv", sample_rows=1).first()
    assert (sampled.row_count, sampled.sampled) == (1, True)


def test_scan_records_takes_the_newest_and_counts_the_broken(spark, tmp_path):
    for i in range(6):
        doc = {"migration_id": f"m{i}", "source_path": "x", "created_at": "2026-01-01T00:00:00Z", "failed": False}
        text = json.dumps(doc)
        path = write(f"{tmp_path}/run{i}/migration_record.json", text[:20] if i == 4 else text)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    got = scan_records(spark, str(tmp_path), limit=3).collect()
    assert sorted(r.migration_id for r in got if r.readable) == ["m3", "m5"]
    assert sum(not r.readable for r in got) == 1
    assert scan_records(spark, str(tmp_path), limit=None).count() == 6


def test_jdbc_arguments_are_checked(spark):
    with pytest.raises(ValueError):
        files.read_sql(spark, "jdbc:x", table="t", query="q")
    with pytest.raises(ValueError):
        files.read_sql(spark, "jdbc:x", table="t", column="c")


def test_texts_survive_a_csv(spark, tmp_path):
    rows = [("  pad ", 1), ("a\nb", 2), ('say "x", y', 3), ("tab\there\r\n", 4), ("é;ü", 5)]
    path = str(tmp_path / "texts")
    files.to_csv(spark.createDataFrame(rows, "t string, n bigint"), path)
    assert sorted((r.t, r.n) for r in files.read_csv(spark, path).collect()) == sorted(rows)


def test_long_integers_and_infinities_keep_their_types(spark, tmp_path):
    path = tmp_path / "big.csv"
    path.write_text("a,b,c\n9223372036854775807,inf,99999999999999999999\n1234567890123456789,-Infinity,1\n")
    df = files.read_csv(spark, str(path))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "double"]
    assert {r.a for r in df.collect()} == {9223372036854775807, 1234567890123456789}
    assert {r.b for r in df.collect()} == {float("inf"), float("-inf")}


def test_json_keeps_columns_without_values(spark, tmp_path):
    path = str(tmp_path / "nulls")
    files.to_json(spark.createDataFrame([(1, None), (2, None)], "a bigint, b string"), path)
    assert files.read_json(spark, path).columns == ["a", "b"]


def test_parts_go_together_by_name(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "1.csv").write_text("a,b\n1,x\n")
    (folder / "2.csv").write_text("b,a\ny,2\n")
    (folder / "3.tsv").write_text("a\tc\n3\t4\n")
    got = datasets.load_dataset(spark, str(folder)).collect()
    assert sorted((r.a, r.b, r.c) for r in got) == [(1, "x", None), (2, "y", None), (3, None, 4.0)]
    parquet = str(tmp_path / "parquet")
    spark.range(1).selectExpr("id AS a").coalesce(1).write.parquet(parquet)
    spark.range(1).selectExpr("id + 1 AS a", "'z' AS b").coalesce(1).write.mode("append").parquet(parquet)
    assert sorted((r.a, r.b) for r in datasets.load_dataset(spark, parquet).collect()) == [(0, None), (1, "z")]


def test_given_directory_is_profiled_whole(spark):
    """Every table as large as given, and a table that is too large to broadcast."""
    import os

    from parity.operators.skew import BROADCAST_LIMIT_BYTES
    from parity.plans import profile_queries

    sf = "/root/testdata/sf0.1"
    files_of = {n: os.path.getsize(f"{sf}/{n}") for n in os.listdir(sf) if n.endswith(".parquet")}
    got = {r.path.rsplit("/", 1)[1]: r for r in profile_queries.given_broadcast_candidates(spark, sf).collect()}
    assert {n: r.size_bytes for n, r in got.items()} == files_of
    assert {n: r.broadcast_candidate for n, r in got.items()} == {n: 0 < b < BROADCAST_LIMIT_BYTES for n, b in files_of.items()}
    assert got["lineitem.parquet"].row_count == spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert {r.broadcast_candidate for r in got.values()} == {True, False}
