"""Hard negatives by exact inner products, searched the way of LEMP.

Rows are ordered by length and packed into length buckets; a bucket keeps, for every coordinate, the list of its rows
in the order of that coordinate of their directions. An anchor that still needs a score of ``t`` leaves out a bucket
whose longest row cannot reach it. Otherwise ``t`` and that length bound the angle to the anchor and so the range of
each coordinate in which a row can lie: the ranges of the anchor's focus coordinates (its largest) are cut out of the
sorted lists, and only rows inside all of them are verified by their exact product. Where even the narrowest range
holds much of a bucket, all of it is verified at once, which is cheaper.

On Spark: the index is one table of packed buckets, dealt by length, never by label, so that a frequent label is spread
like any other. Each task holds a bounded number of buckets and goes through the anchors block by block from a table in
the shared folder; it hands on the best few rows of each anchor. First one bucket in ``SEED`` is searched: the k-th best
score found there is a bound that lets the search of all buckets hand on little, however many tasks there are.

Defined results: components are floor(256 * x). Rows with a null id, label or vector, or a null, NaN or infinite
component, or a length of 2^28 or more after that (their products would not fit) take no part. Vectors of unequal
dimension are compared as if the shorter one went on with zeros. Every row is its own: rows that repeat an id are other
rows to each other, and each of them is an anchor if its id is one. Ties go to the smaller id. An empty table or one
without anchors gives no rows. Other columns are left out. Ids and labels are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parity.llm.files import parquet_batches, scratch_uri

#: Rows and numbers in a bucket at most; a bucket also ends where lengths fall below a share of its longest.
ROWS, NUMBERS, SHARE, LEAST_ROWS = 2048, 1 << 20, 0.9, 64
#: Rows of a partition of the index; bytes of buckets a task searches at a time; anchors searched at a time.
PART_ROWS, HELD, BLOCK = 1 << 18, 48 << 20, 512
#: Coordinates looked at of each anchor; share of a bucket beyond which it is verified as a whole.
FOCUS, MUCH = 4, 0.2
#: One bucket in this many is searched for bounds first.
SEED = 16
#: Less than any product, and exact as a double.
NONE = -(2**62)
BUCKET = (
    "bucket bigint, n int, dim int, longest double, shortest double, ids binary, labels binary, anchors binary, "
    "width int, numbers binary, lists binary"
)
QUERY = "query bigint, own bigint, label bigint, numbers binary, low bigint, high bigint"


def prepared(rows: DataFrame, anchor: Column, vec_id: str, embedding: str, label: str) -> DataFrame:
    """The rows that take part: id, label, numbers, square (of the length), anchor."""
    x = F.col(embedding)
    whole = x.isNotNull() & ~F.exists(
        x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf"))
    )
    found = rows.where(whole & F.col(label).isNotNull() & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("bigint").alias("id"),
        F.col(label).cast("bigint").alias("label"),
        F.transform(x, lambda v: F.expr("double(256)") * v.cast("double")).alias("scaled"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
    )
    bounded = F.aggregate("scaled", F.lit(0.0), lambda s, v: s + F.floor(v).cast("double") * F.floor(v).cast("double"))
    found = found.where(~F.exists("scaled", lambda v: F.abs(v) >= 2.0**28)).withColumn("square", bounded)
    return found.where(F.col("square") < 2.0**56).select(
        "id", "label", "anchor", "square", F.transform("scaled", lambda v: F.floor(v).cast("bigint")).alias("numbers")
    )


def index(rows: DataFrame) -> DataFrame:
    """Packed length buckets (BUCKET) of prepared rows."""
    spark = rows.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-rows.count() // PART_ROWS))
    order = [F.col("square").desc(), F.col("id"), F.xxhash64("label", "numbers")]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        waiting: list[tuple] = []
        cells = 0

        for batch in batches:
            squares = batch.column("square").to_numpy()
            lists = batch.column("numbers")
            edges = lists.offsets.to_numpy()
            flat = lists.values.to_numpy()
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label", "anchor")]
            for k in range(batch.num_rows):
                own = flat[edges[k] : edges[k + 1]]
                size = np.sqrt(squares[k])
                wide = max([len(own), cells])
                full = len(waiting) >= ROWS or (len(waiting) + 1) * wide > NUMBERS
                if waiting and (full or (len(waiting) >= LEAST_ROWS and size < SHARE * waiting[0][0])):
                    yield packed(number, waiting)
                    number, waiting, wide = number + 1, [], len(own)
                waiting.append((size, *(c[k] for c in columns), own))
                cells = wide
        if waiting:
            yield packed(number, waiting)

    return dealt.mapInArrow(pack, BUCKET)


def packed(number: int, rows: list[tuple]) -> pa.RecordBatch:
    dim = max(len(r[4]) for r in rows)
    numbers = np.zeros((len(rows), dim), np.int64)
    for k, r in enumerate(rows):
        numbers[k, : len(r[4])] = r[4]
    most = int(np.abs(numbers).max(initial=0))
    width = 2 if most < 2**15 else 8
    lengths = np.array([r[0] for r in rows])
    lists = np.argsort(directions(numbers, lengths), axis=0, kind="stable").T.astype(np.uint16)
    values = {
        "bucket": number, "n": len(rows), "dim": dim, "longest": lengths[0], "shortest": lengths[-1],
        "ids": np.array([r[1] for r in rows], np.int64).tobytes(),
        "labels": np.array([r[2] for r in rows], np.int64).tobytes(),
        "anchors": np.array([r[3] for r in rows], bool).tobytes(),
        "width": width, "numbers": numbers.astype(f"<i{width}").tobytes(), "lists": lists.tobytes(),
    }
    kinds = {"n": pa.int32(), "dim": pa.int32(), "width": pa.int32(), "bucket": pa.int64()}
    arrays = [pa.array([v], kinds.get(c)) for c, v in values.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(values))


def directions(numbers: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return numbers / np.where(lengths > 0, lengths, 1)[:, None]


class Bucket:
    def __init__(self, row: dict):
        n, self.dim = row["n"], row["dim"]
        self.longest, self.shortest = row["longest"], row["shortest"]
        self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        self.anchors = np.frombuffer(row["anchors"], bool)
        self.numbers = np.frombuffer(row["numbers"], f"<i{row['width']}").reshape(n, self.dim)
        self.lists = np.frombuffer(row["lists"], np.uint16).reshape(self.dim, n)
        #: Names each row of the index.
        self.keys = (row["bucket"] << 16) + np.arange(n)

    def sorted_directions(self) -> np.ndarray:
        """For each coordinate the values of its list."""
        lengths = np.sqrt((self.numbers.astype(np.float64) ** 2).sum(axis=1))
        return np.take_along_axis(directions(self.numbers, lengths).T, self.lists.astype(np.int64), axis=1)


def anchors_of(buckets: DataFrame) -> DataFrame:
    """The anchors as queries without bounds (QUERY), with their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Bucket(row)
                at = np.flatnonzero(b.anchors)
                if len(at):
                    numbers = [x.tobytes() for x in b.numbers[at].astype(np.int64)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(b.keys[at]), pa.array(b.ids[at]), pa.array(b.labels[at]), pa.array(numbers)],
                        names=["own", "anchor_id", "label", "numbers"],
                    )

    return buckets.mapInArrow(run, "own bigint, anchor_id bigint, label bigint, numbers binary")


class Block:
    """Some queries, and the best ``k`` rows found for each so far."""

    def __init__(self, batch: pa.RecordBatch, k: int):
        self.query, self.own, self.label, self.low, self.high = (
            batch.column(c).to_numpy() for c in ("query", "own", "label", "low", "high")
        )
        raw = [np.frombuffer(x, np.int64) for x in batch.column("numbers").to_pylist()]
        self.dim = max(map(len, raw), default=0)
        self.numbers = np.zeros((len(raw), self.dim), np.int64)
        for i, x in enumerate(raw):
            self.numbers[i, : len(x)] = x
        self.lengths = np.sqrt((self.numbers.astype(np.float64) ** 2).sum(axis=1))
        self.units = directions(self.numbers, self.lengths)
        self.focus = np.argsort(-np.abs(self.units), axis=1, kind="stable")[:, :FOCUS]
        self.k = k
        self.score = np.full((len(raw), k), NONE, np.int64)
        self.id, self.key = (np.zeros((len(raw), k), np.int64) for _ in range(2))

    def need(self) -> np.ndarray:
        """The score a row must reach; equal scores may still win by their id."""
        return np.maximum(self.low, self.score[:, -1])

    def search(self, b: Bucket, same: bool) -> None:
        need = self.need()
        reach = self.lengths * b.longest
        active = np.flatnonzero((need <= 0) | (need <= reach * (1 + 1e-9)))
        if not len(active):
            return
        dim = min(self.dim, b.dim)
        numbers = b.numbers[:, :dim]
        share, ranges = self.ranges(b, active, need, dim)
        whole = active[share > MUCH]
        for some in np.array_split(whole, -(-len(whole) // 128) if len(whole) else 1):
            if len(some):
                self.verify(b, some, self.products(numbers, some, dim, reach.max(initial=0)), same, None)
        ranks: dict[int, np.ndarray] = {}
        for i, bounds in ((active[j], ranges[j]) for j in np.flatnonzero(share <= MUCH)):
            rows = self.inside(b, bounds, ranks)
            if len(rows):
                some = np.array([i])
                self.verify(b, some, self.products(numbers[rows], some, dim, reach.max(initial=0)), same, rows)

    def ranges(self, b: Bucket, active: np.ndarray, need: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """(share of the bucket in the narrowest range, (coordinate, from, to) of each focus coordinate)."""
        n = len(b.ids)
        # the least cosine a row of the bucket needs
        size = np.where(need > 0, b.longest, b.shortest) * self.lengths
        least = np.full(len(need), -1.0)
        least = np.clip(np.divide(need, size, out=least, where=size > 0), -1, 1)[active, None]
        focus = self.focus[active]
        c = np.take_along_axis(self.units[active], focus, axis=1)
        half = np.sqrt((1 - c * c).clip(0) * (1 - least * least).clip(0))
        low = np.where(-c >= least, -1, c * least - half) - 1e-9
        high = np.where(c >= least, 1, c * least + half) + 1e-9
        found = np.zeros((*focus.shape, 3), np.int64)
        found[..., 0], found[..., 2] = focus, n
        values = b.sorted_directions()
        for f in np.unique(focus):
            if f < dim:
                at = np.nonzero(focus == f)
                found[(*at, 1)] = np.searchsorted(values[f], low[at], "left")
                found[(*at, 2)] = np.searchsorted(values[f], high[at], "right")
        sizes = found[..., 2] - found[..., 1]
        return sizes.min(axis=1, initial=n) / n, found

    def inside(self, b: Bucket, bounds: np.ndarray, ranks: dict[int, np.ndarray]) -> np.ndarray:
        """The rows that lie in every range: those of the narrowest, looked up in the other lists."""
        order = np.argsort(bounds[:, 2] - bounds[:, 1])
        f, start, stop = bounds[order[0]]
        rows = b.lists[f, start:stop].astype(np.int64) if f < b.dim else np.arange(len(b.ids))
        for f, start, stop in bounds[order[1:]]:
            if f < b.dim and stop - start < len(b.ids):
                if f not in ranks:
                    ranks[f] = np.argsort(b.lists[f], kind="stable")
                rank = ranks[f][rows]
                rows = rows[(rank >= start) & (rank < stop)]
        return np.sort(rows)

    def products(self, numbers: np.ndarray, some: np.ndarray, dim: int, reach: float) -> np.ndarray:
        """Exact: as doubles while every partial sum fits in 53 bits, else as integers."""
        mine = self.numbers[some, :dim]
        if reach < 2.0**52:
            return (mine.astype(np.float64) @ numbers.T.astype(np.float64)).astype(np.int64)
        return mine @ numbers.T.astype(np.int64)

    def verify(self, b: Bucket, some: np.ndarray, scores: np.ndarray, same: bool, rows: np.ndarray | None) -> None:
        """Take the scores of ``rows`` (all if None) of the bucket for the queries ``some``."""
        ids, labels, keys = (x if rows is None else x[rows] for x in (b.ids, b.labels, b.keys))
        fits = (labels[None, :] == self.label[some, None]) == same
        fits &= (keys[None, :] != self.own[some, None]) & (scores <= self.high[some, None])
        scores = np.where(fits, scores, NONE)
        need = np.maximum(self.low, self.score[:, -1])[some]
        if scores.shape[1] > self.k:
            need = np.maximum(need, np.partition(scores, -self.k, axis=1)[:, -self.k])
        at, row = np.nonzero((scores >= need[:, None]) & (scores > NONE))
        if not len(at):
            return
        touched, at_new = np.unique(at, return_inverse=True)
        q = some[touched]
        old = np.repeat(np.arange(len(q)), self.k)
        every = np.concatenate([old, at_new])
        score = np.concatenate([self.score[q].ravel(), scores[at, row]])
        names = np.concatenate([self.id[q].ravel(), ids[row]])
        key = np.concatenate([self.key[q].ravel(), keys[row]])
        order = np.lexsort((key, names, -score, every))
        place = np.arange(len(order)) - np.searchsorted(every[order], every[order], "left")
        best = order[place < self.k]
        for own, found in ((self.score, score), (self.id, names), (self.key, key)):
            own[q] = found[best].reshape(len(q), self.k)

    def found(self) -> pa.RecordBatch:
        at, place = np.nonzero(self.score > NONE)
        columns = {
            "query": self.query[at], "score": self.score[at, place], "id": self.id[at, place],
            "key": self.key[at, place],
        }
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], names=list(columns))


def searched(buckets: DataFrame, queries: str, k: int, same: bool) -> DataFrame:
    """(query, score, id, key) of the best ``k`` rows of each query of the table ``queries`` (QUERY)."""

    def sweep(held: list[Bucket]) -> Iterator[pa.RecordBatch]:
        for batch in parquet_batches(queries, BLOCK):
            block = Block(batch, k)
            for b in held:
                block.search(b, same)
            yield block.found()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                held.append(Bucket(row))
                size += len(row["numbers"]) + len(row["lists"]) + 17 * row["n"]
                if size > HELD:
                    yield from sweep(held)
                    held, size = [], 0
        if held:
            yield from sweep(held)

    parts = buckets.mapInArrow(run, "query bigint, score bigint, id bigint, key bigint")
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "id", "key")
    return parts.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def best_rows(buckets: DataFrame, queries: DataFrame, k: int, same: bool, folder: str) -> DataFrame:
    """``searched`` with bounds from one bucket in SEED; ``queries`` is a table already written."""
    spark = queries.sparkSession
    queries.write.parquet(f"{folder}/asked")
    asked = spark.read.parquet(f"{folder}/asked")
    seed = searched(buckets.where(F.col("bucket") % SEED == 0), f"{folder}/asked", k, same)
    bound = seed.where(F.col("place") == k).select("query", F.col("score").alias("bound"))
    bounded = asked.join(bound, "query", "left").withColumn("low", F.greatest("low", F.coalesce("bound", "low")))
    bounded.drop("bound").write.parquet(f"{folder}/bounded")
    searched(buckets, f"{folder}/bounded", k, same).write.parquet(f"{folder}/found")
    return spark.read.parquet(f"{folder}/found")


def mined(
    rows: DataFrame,
    anchor: Column,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    positives: int = 5,
    negatives: int = 3,
    least: int = 50,
    most: int = 95,
) -> DataFrame:
    """For each anchor (rows where ``anchor`` holds) and each of its ``positives`` best rows of its label, the best
    ``negatives`` rows of other labels whose score is ``least`` to ``most`` percent of the positive's: anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score."""
    for column in (vec_id, label):
        if rows.schema[column].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
            raise ValueError(f"{column} must be an integer column")
    spark = rows.sparkSession
    folder = scratch_uri(spark, "lemp")
    index(prepared(rows, anchor, vec_id, embedding, label)).write.parquet(f"{folder}/index")
    buckets = spark.read.parquet(f"{folder}/index")
    anchors_of(buckets).write.parquet(f"{folder}/anchors")
    anchors = spark.read.parquet(f"{folder}/anchors")
    asked = anchors.select(
        F.col("own").alias("query"), "own", "label", "numbers",
        F.lit(NONE).cast("bigint").alias("low"), F.lit(-NONE).cast("bigint").alias("high"),
    )
    near = best_rows(buckets, asked, positives, True, f"{folder}/positives").select(
        F.col("query").alias("own"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
        F.col("place").alias("nth"),
    )
    # bounds of the negatives as whole numbers; a negative score bounds nothing
    bands = near.where("positive_score >= 0").select("own", "positive_score").distinct().select(
        "own", "positive_score",
        F.expr(f"(positive_score * {least} + 99) div 100").alias("low"),
        F.expr(f"(positive_score * {most}) div 100").alias("high"),
    )
    bands = bands.withColumn("query", F.monotonically_increasing_id())
    bands.write.parquet(f"{folder}/bands")
    bands = spark.read.parquet(f"{folder}/bands")
    asked = bands.join(anchors, "own").select("query", "own", "label", "numbers", "low", "high")
    far = best_rows(buckets, asked, negatives, False, f"{folder}/negatives").select(
        "query", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), F.col("place").alias("rank")
    )
    return (
        near.join(bands.select("query", "own", "positive_score"), ["own", "positive_score"])
        .join(far, "query")
        .join(anchors.select("own", "anchor_id"), "own")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
