"""Quoted CSV with line breaks inside cells, read by as many tasks as the files have splits.

A line break inside quotes makes it unknown, in the middle of a file, whether a line begins a record. Each line maps the
state before it (outside or inside quotes) to the state after it, under both assumptions; so does a split, by composing
its lines, and the state at any split is the composition of the splits before it. A first pass over the lines that
hold a quote yields those maps, one row a split; a window over them gives the ranges of splits that begin inside quotes.
A second pass puts lines together into records. Only the ends of a split that belong to a record of several splits are
shuffled.

Files whose lines all end outside quotes have no such break and are left to Spark's own line reader.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranges of splits that begin inside quotes, up to which they are sent to every task.
BROADCAST_RANGES = 100_000

_QUOTED = re.compile(r'[^"]*(?:""[^"]*)*')
#: What a line or split makes of (outside, inside): its own row of states.
Map = tuple[bool, bool]


def _after_quote(line: str, at: int) -> int:
    """Place after the quote that closes the cell whose text begins at ``at``; -1 if the line ends first."""
    end = _QUOTED.match(line, at).end()
    return end + 1 if end < len(line) else -1


def ends_inside(line: str, sep: str, inside: bool) -> bool:
    """Whether the line end is inside quotes. Only a quote at the beginning of a cell opens it."""
    at = 0
    while True:
        if inside or (at < len(line) and line[at] == '"'):
            at = _after_quote(line, at if inside else at + 1)
            if at < 0:
                return True
            inside = False
        at = line.find(sep, at) + 1
        if at == 0:
            return False


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Physical lines in the order of their split: path, start (of the split), value."""
    lines = spark.read.option("lineSep", "\n").text(paths)
    return lines.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value"
    )


def split_maps(lines: DataFrame, sep: str) -> DataFrame:
    """For each split with a quote: path, start, outside and inside (the state after it from either state before), and
    breaks (whether a line ends inside quotes if the split begins outside)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list[bool]] = {}
        for batch in batches:
            for path, start, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                state = found.setdefault((path, start), [False, True, False])
                same = state[0] == state[1]
                state[0] = ends_inside(line, sep, state[0])
                state[1] = state[0] if same else ends_inside(line, sep, state[1])
                state[2] |= state[0]
        if found:
            rows = [(*k, *v) for k, v in found.items()]
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "start", "outside", "inside", "breaks"])

    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()]
    quoted = lines.filter(F.col("value").contains('"'))
    return quoted.mapInArrow(run, "path string, start bigint, outside boolean, inside boolean, breaks boolean")


def inside_ranges(maps: DataFrame) -> DataFrame:
    """path, after, upto: splits that start in (after, upto] begin inside quotes."""
    order = Window.partitionBy("path").orderBy("start")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    constant = F.col("outside") == F.col("inside")
    flips = F.sum(F.when(~constant & F.col("outside"), 1).otherwise(0)).over(so_far)
    known = maps.withColumn("flips", flips)
    # a split that ends alike from either state settles it; after that only flips count. A file begins outside.
    settled = F.last(F.when(constant, F.struct("outside", "flips")), ignorenulls=True).over(so_far)
    since = F.col("flips") - F.coalesce(settled["flips"], F.lit(0))
    state = F.coalesce(settled["outside"], F.lit(False)) != (since % 2 == 1)
    upto = F.coalesce(F.lead("start").over(order), F.lit(2**63 - 1))
    return known.select("path", F.col("start").alias("after"), upto.alias("upto"), state.alias("state")).filter("state").drop("state")


def _begun(lines: DataFrame, ranges: DataFrame, limit: int) -> DataFrame:
    """The lines with ``begun``: whether their split begins inside quotes. Lines of a split stay together in order."""
    within = (F.col("l.path") == F.col("r.path")) & (F.col("l.start") > F.col("r.after")) & (F.col("l.start") <= F.col("r.upto"))
    if ranges.count() <= limit:
        joined = lines.alias("l").join(F.broadcast(ranges).alias("r"), within, "left")
        return joined.select("l.path", "l.start", "l.value", F.col("r.after").isNotNull().alias("begun"))
    starts = lines.select("path", "start").distinct()
    begun = starts.alias("l").join(ranges.alias("r"), within, "left_semi").withColumn("begun", F.lit(True))
    numbered = lines.withColumn("nth", F.monotonically_increasing_id())
    joined = numbered.join(begun, ["path", "start"], "left").repartition("path", "start")
    return joined.sortWithinPartitions("path", "start", "nth").select(
        "path", "start", "value", F.coalesce("begun", F.lit(False)).alias("begun")
    )


WHOLE, HEAD, TAIL = 0, 1, 2


def records(lines: DataFrame, ranges: DataFrame, sep: str, limit: int = BROADCAST_RANGES) -> DataFrame:
    """Every record as text: value, and whether it is the ``first`` of its file. Empty lines are no records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = None
        held: list[str] = []  # lines of the record that is open
        inside = from_before = first = False

        def rows(kind: int, values, firsts) -> pa.RecordBatch:
            n = len(values)
            return pa.RecordBatch.from_arrays(
                [pa.array([split[0]] * n, pa.string()), pa.array([split[1]] * n, pa.int64()),
                 pa.array([kind] * n, pa.int32()), values, pa.array(firsts, pa.bool_())],
                names=["path", "start", "kind", "value", "first"],
            )

        def closed(kind: int) -> pa.RecordBatch | None:
            nonlocal held, from_before, first
            text, mark = "\n".join(held), first and kind != HEAD
            held, from_before = [], False
            if kind == WHOLE and not text.rstrip("\r"):
                return None
            first = first and kind == HEAD
            return rows(kind, pa.array([text.removesuffix("\r") if kind == WHOLE else text], pa.string()), [mark])

        def ended() -> pa.RecordBatch | None:
            return closed(HEAD if from_before else TAIL) if inside else None

        for batch in batches:
            columns = [batch.column(k) for k in range(4)]
            edges = pc.or_(
                pc.not_equal(columns[0][1:], columns[0][:-1]), pc.not_equal(columns[1][1:], columns[1][:-1])
            ).to_numpy(zero_copy_only=False).nonzero()[0].tolist() if batch.num_rows > 1 else []
            for a, b in zip([0, *[e + 1 for e in edges]], [*[e + 1 for e in edges], batch.num_rows], strict=True):
                if a == b:
                    continue
                now = (columns[0][a].as_py(), columns[1][a].as_py())
                if now != split:
                    if split is not None and (last := ended()) is not None:
                        yield last
                    split, held = now, []
                    inside = from_before = columns[3][a].as_py()
                    first = now[1] == 0
                values = columns[2].slice(a, b - a)
                at = 0
                for k in [*pc.match_substring(values, '"').to_numpy(zero_copy_only=False).nonzero()[0].tolist(), b - a]:
                    # lines without a quote keep the state
                    if inside:
                        held.extend(values.slice(at, k - at).to_pylist())
                    elif k > at:
                        plain = pc.replace_substring_regex(values.slice(at, k - at), "\r$", "")
                        plain = plain.filter(pc.not_equal(plain, ""))
                        if len(plain):
                            yield rows(WHOLE, plain, [first] + [False] * (len(plain) - 1))
                            first = False
                    if k < b - a:
                        line = values[k].as_py()
                        held.append(line)
                        inside = ends_inside(line, sep, inside)
                        if not inside and (row := closed(HEAD if from_before else WHOLE)) is not None:
                            yield row
                    at = k + 1
        if split is not None and (last := ended()) is not None:
            yield last

    found = _begun(lines, ranges, limit).mapInArrow(
        run, "path string, start bigint, kind int, value string, first boolean"
    )
    whole = found.filter(F.col("kind") == WHOLE).select("value", "first")
    before = Window.partitionBy("path").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    parts = found.filter(F.col("kind") != WHOLE).withColumn(
        "opened", F.last(F.when(F.col("kind") == TAIL, F.col("start")), ignorenulls=True).over(before)
    )
    piece = F.sort_array(F.collect_list(F.struct("start", "kind", "value")))
    joined = parts.groupBy("path", "opened").agg(
        F.array_join(F.transform(piece, lambda p: p["value"]), "\n").alias("value"), F.bool_or("first").alias("first")
    )
    return whole.unionByName(joined.select(F.regexp_replace("value", "\r$", "").alias("value"), "first"))


def header_names(record: str, sep: str) -> list[str]:
    """Column names as Spark's reader gives them: empty ones by place, repeated ones with their place."""
    cells = next(csv.reader([record], delimiter=sep)) if "\n" not in record else next(csv.reader(record.splitlines(True), delimiter=sep))
    folded = [c.lower() for c in cells]
    return [f"_c{i}" if not c else f"{c}{i}" if folded.count(c.lower()) > 1 else c for i, c in enumerate(cells)]


def read_split_csv(
    spark: SparkSession, paths: list[str], sep: str, limit: int = BROADCAST_RANGES, **options
) -> DataFrame:
    """Header files of one layout as text columns, quoted line breaks included, without giving a file to one task.

    A cell is quoted if its first character is a quote, and quotes in it are doubled. Lines end with a line feed, with
    or without a carriage return before it. A record must fit in a task's memory."""
    lines = _lines(spark, paths)
    maps = split_maps(lines, sep)
    if maps.filter("breaks").isEmpty():
        return spark.read.csv(paths, header=True, sep=sep, escape='"', **options)
    ranges = inside_ranges(maps)
    rows = records(lines, ranges, sep, limit)
    head = rows.filter("first").select("value").first()
    if head is None:
        return spark.createDataFrame([], T.StructType([]))
    names = [name.replace("`", "``") for name in header_names(head["value"], sep)]
    ddl = ", ".join(f"`{name}` string" for name in names)
    told = {"sep": sep, "escape": '"', "multiLine": "true"}
    told |= {k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()}
    text = rows.filter("not first").select(F.from_csv("value", ddl, told).alias("r"))
    return text.select("r.*")

