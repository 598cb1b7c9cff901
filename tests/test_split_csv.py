"""Quoted CSV read in splits against Spark's reader of whole files and against pandas."""

import csv
import io
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from parity.sources import files, split_csv


def reader(spark, path):
    return spark.read.csv(path, header=True, escape='"', multiLine=True, nullValue="",
                          ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def rows(df):
    return sorted(tuple("~" if v is None else v for v in r) for r in df.collect())


def split_rows(spark, path, limit=split_csv.BROADCAST_RANGES):
    return rows(split_csv.read_split_csv(
        spark, [path], ",", limit, nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ))


def awkward(seed, n, end="\n"):
    rng = random.Random(seed)
    cells = ["x", "", 'say ""hi""', "a\nb", "\n", '""', 'q""\n""q', "é\nü", "plain text", "1,5", "line" * 8, '""\n']
    out = ["k,text,note"]
    for i in range(n):
        text = rng.choice(cells)
        quoted = any(c in text for c in ',"\n') or rng.random() < 0.3
        note = rng.choice(["", "n", f'"{rng.choice(cells)}"', 'a 5" pipe', 'end"'])
        out.append(f"{i},{chr(34) + text + chr(34) if quoted else text},{note}")
    return end.join(out) + rng.choice(["", end])


@pytest.fixture
def splits(spark):
    """Set the size of splits; back to what it was afterwards."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    yield lambda size: [spark.conf.set(n, str(size)) for n in names]
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("size", [7, 16, 61, 300])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_are_those_of_the_whole_file(spark, tmp_path, splits, size, end):
    path = f"{tmp_path}/x.csv"
    with open(path, "w", newline="") as handle:
        handle.write(awkward(size, 40, end))
    expected = rows(reader(spark, path))
    splits(size)
    assert spark.read.text(path).rdd.getNumPartitions() > 2
    assert split_rows(spark, path) == expected


@pytest.mark.parametrize("limit", [split_csv.BROADCAST_RANGES, 0])
def test_a_quote_at_every_edge(spark, tmp_path, splits, limit):
    """The same cells moved byte by byte past the edge of a split."""
    for pad in range(0, 12, 3):
        path = f"{tmp_path}/{pad}.csv"
        with open(path, "w") as handle:
            handle.write(f'k,text\n{"p" * pad},"a\n""b""\n\n"\n2,"""\n"""\n3,plain\n4,"open\nto the, end"\n')
        expected = rows(reader(spark, path))
        splits(12)
        assert split_rows(spark, path, limit) == expected


def test_one_cell_over_many_splits(spark, tmp_path, splits):
    path = f"{tmp_path}/long.csv"
    long = "\n".join(f'line {i}, of ""one"" cell' for i in range(200))
    with open(path, "w") as handle:
        handle.write(f'k,"te\nxt"\n1,a\n2,"{long}"\n3,b\n')
    expected = reader(spark, path)
    splits(64)
    found = split_csv.read_split_csv(spark, [path], ",")
    assert found.columns == ["k", "te\nxt"]
    assert rows(found) == rows(expected) and len(rows(found)) == 3


def test_types_and_several_files_as_pandas(spark, tmp_path, splits):
    frames = []
    for part in range(3):
        pdf = pd.DataFrame({
            "k": range(part * 50, part * 50 + 50),
            "text": [f"row {i}\nof {part}" if i % 3 else "NA" for i in range(50)],
            "v": [i / 4 if i % 5 else None for i in range(50)],
        })
        pdf.to_csv(f"{tmp_path}/part-{part}.csv", index=False, quoting=csv.QUOTE_MINIMAL)
        frames.append(pd.read_csv(f"{tmp_path}/part-{part}.csv"))
    splits(200)
    got = files.read_csv(spark, [f"{tmp_path}/part-{p}.csv" for p in range(3)])
    assert dict(got.dtypes) == {"k": "bigint", "text": "string", "v": "double"}
    expected = pd.concat(frames)
    assert {(r.k, r.text, r.v) for r in got.collect()} == {
        (k, None if pd.isna(t) else t, None if pd.isna(v) else v) for k, t, v in expected.itertuples(index=False)
    }


def test_files_without_breaks_are_left_to_spark(spark, tmp_path):
    path = f"{tmp_path}/x.csv"
    with open(path, "w") as handle:
        handle.write('a,b\n1,"x, y"\n2,5" pipe\n')
    plan = split_csv.read_split_csv(spark, [path], ",")._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "FileScan csv" in plan


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path, splits):
    buffer = io.StringIO()
    writer = csv.writer(buffer, lineterminator="\n")
    writer.writerow(["k", "text"])
    writer.writerows((i, f"line one of {i}\nline \"two\"") for i in range(60_000))
    path = f"{tmp_path}/large.csv"
    with open(path, "w") as handle:
        handle.write(buffer.getvalue())
    splits(200_000)
    found = split_csv.read_split_csv(spark, [path], ",")
    assert found.rdd.getNumPartitions() > 8
    sums = found.agg(F.count("*").alias("n"), F.sum(F.col("k").cast("bigint")).alias("k"),
                     F.count_if(F.col("text").endswith('"two"')).alias("t")).first()
    assert (sums.n, sums.k, sums.t) == (60_000, sum(range(60_000)), 60_000)


@pytest.mark.parametrize(
    ("line", "inside", "after"),
    [("a,b", False, False), ('"a', False, True), ('"a""', False, True), ('a"b', False, False), ('x",y', True, False),
     ('x"",y', True, True), ('x","y', True, True), ("", True, True), ('"",""', False, False)],
)
def test_states_of_lines(line, inside, after):
    assert split_csv.ends_inside(line, ",", inside) is after
