"""Token ids as binary shards with constant-time keyed access.

Documents are range-partitioned by id, so shards follow each other in ascending id order. A task encodes its shard
batch by batch into a raw payload file (little-endian ids, two bytes each where the vocabulary allows it, else four)
and then writes the index of the shard:

    magic, version, id width, rows, distinct keys, buckets, rows without a key (they come first)
    keys (int64), offsets and lengths in ids (int64)          one entry for each document, in payload order
    displacements (int32)                                     minimal perfect hash of the distinct keys
    fingerprints (uint32), first row and row count (int32)    one entry for each slot

A key is hashed to a bucket, the bucket's displacement gives its slot and the stored fingerprint rejects keys that
are not there, so reading a document takes one probe and one seek. Repeated ids stand side by side and share a slot.
Reading all documents probes the same index for every key, so what comes back is what a keyed reader would get.

Files are written under a name of the attempt and then moved in place, so a repeated task leaves the same bytes. What
the tasks report (one row a shard) is checkpointed: shards are written once however often the report is read.

Defined results: null and empty texts are the end id alone; rows with a null id come first and cannot be looked up;
repeated ids keep all their rows, ordered by the hash of the text. An empty table gives no shard. Extra columns are
left out. Ids are integers of any size up to 64 bits; ids of other types are refused. A text must fit in a worker's
memory; texts are encoded about CHUNK bytes at a time.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parity.llm.files import opened, publish, scratch_uri
from parity.llm.pieces import encoder

MAGIC, VERSION = b"TIDX", 2
HEADER = struct.Struct("<4sIIqqqq")
#: Bytes of text encoded at a time, and bytes of a payload read at a time.
CHUNK, READ = 1 << 23, 1 << 24
KEYS_PER_BUCKET = 4

SHARDS = "shard int, uri string, rows bigint, n_ids bigint, first_id bigint, last_id bigint"


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Well spread 64-bit values of 64-bit values."""
    x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 7) >> np.uint64(32)).astype(np.uint32)


def perfect_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(displacements, slot of each key) for distinct keys. The fullest buckets are placed first; a bucket of one key
    takes a free slot directly, written as -1 - slot."""
    n = len(keys)
    buckets = max(1, -(-n // KEYS_PER_BUCKET))
    moves, slots, taken = np.zeros(buckets, np.int32), np.zeros(n, np.int64), np.zeros(n, bool)
    if n == 0:
        return moves, slots
    bucket = (mixed(keys, 0) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=buckets)
    first = np.cumsum(sizes) - sizes
    free = None
    for b in np.argsort(-sizes, kind="stable"):
        members = order[first[b] : first[b] + sizes[b]]
        if sizes[b] > 1:
            move, at = _first_fit(keys[members], taken)
            moves[b], slots[members] = move, at
            taken[at] = True
        elif sizes[b] == 1:
            free = iter(np.flatnonzero(~taken).tolist()) if free is None else free
            at = next(free)
            moves[b], slots[members] = -1 - at, at
    return moves, slots


def _first_fit(keys: np.ndarray, taken: np.ndarray) -> tuple[int, np.ndarray]:
    """The least displacement that puts the keys on free slots of their own; candidates are tried in growing blocks."""
    first, block = 1, 16
    while True:
        at = np.sort(_slots(keys[None, :], np.arange(first, first + block)[:, None], len(taken)), axis=1)
        fits = np.flatnonzero(~taken[at].any(axis=1) & (at[:, 1:] != at[:, :-1]).all(axis=1))
        if len(fits):
            move = first + int(fits[0])
            return move, _slots(keys, np.full(len(keys), move, np.int64), len(taken))
        first, block = first + block, min(2 * block, 4096)


def _slots(keys: np.ndarray, moves: np.ndarray, n: int) -> np.ndarray:
    return (mixed(keys ^ (moves * np.int64(0x5DEECE66D)), 3) % np.uint64(n)).astype(np.int64)


def index_bytes(keys: np.ndarray, lengths: np.ndarray, width: int, unnamed: int) -> bytes:
    """The index of documents in payload order; the first ``unnamed`` have no key."""
    offsets = np.cumsum(lengths) - lengths
    distinct, first, count = np.unique(keys[unnamed:], return_index=True, return_counts=True)
    moves, slots = perfect_hash(distinct)
    prints, row, rows = (np.zeros(len(distinct), t) for t in (np.uint32, np.int32, np.int32))
    prints[slots], row[slots], rows[slots] = fingerprints(distinct), first + unnamed, count
    head = HEADER.pack(MAGIC, VERSION, width, len(keys), len(distinct), len(moves), unnamed)
    return head + b"".join(
        x.tobytes()
        for x in (keys.astype("<i8"), offsets.astype("<i8"), lengths.astype("<i8"), moves.astype("<i4"),
                  prints.astype("<u4"), row.astype("<i4"), rows.astype("<i4"))
    )


class Shard:
    """A shard opened for reading."""

    def __init__(self, uri: str):
        system, path = opened(uri)
        with system.open_input_file(f"{path}.idx") as f:
            data = f.read()
        magic, version, self.width, rows, keys, buckets, self.unnamed = HEADER.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"{uri} is no index of token ids")
        at = HEADER.size
        parts = []
        for kind, n in (("<i8", rows),) * 3 + (("<i4", buckets), ("<u4", keys), ("<i4", keys), ("<i4", keys)):
            parts.append(np.frombuffer(data, kind, n, at))
            at += parts[-1].nbytes
        self.keys, self.offsets, self.lengths, self.moves, self.prints, self.row, self.rows = parts
        self.payload = system.open_input_file(f"{path}.ids")
        self.kind = "<u2" if self.width == 2 else "<u4"

    def ids(self, start: int, n: int) -> np.ndarray:
        self.payload.seek(start * self.width)
        return np.frombuffer(self.payload.read(n * self.width), self.kind).astype("<u4")

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first row, number of rows) of each key; no rows where the key is not there."""
        n = len(self.prints)
        if n == 0 or len(keys) == 0:
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        move = self.moves[(mixed(keys, 0) % np.uint64(len(self.moves))).astype(np.int64)].astype(np.int64)
        at = np.where(move < 0, -1 - move, _slots(keys, move, n))
        row = self.row[at].astype(np.int64)
        there = (self.prints[at] == fingerprints(keys)) & (self.keys[row] == keys)
        return row, np.where(there, self.rows[at], 0)

    def find(self, key: int) -> tuple[int, int] | None:
        """(offset, length) in ids of all rows with this key."""
        (row,), (rows,) = self.probe(np.array([key], np.int64))
        return (int(self.offsets[row]), int(self.lengths[row : row + rows].sum())) if rows else None

    def get(self, key: int) -> np.ndarray | None:
        found = self.find(key)
        return None if found is None else self.ids(*found)

    def rows_by_key(self) -> np.ndarray:
        """The row of every document as the index gives it for the document's key, in payload order."""
        keys = np.unique(self.keys[self.unnamed :])
        row, rows = self.probe(keys)
        named = np.repeat(row - (np.cumsum(rows) - rows), rows) + np.arange(int(rows.sum()))
        if len(named) + self.unnamed != len(self.keys):
            raise ValueError("the index does not find all of its keys")
        return np.concatenate([np.arange(self.unnamed), named])

    def documents(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(row, offset, ids) of every document, found by its key; the payload is read in bounded pieces."""
        found = self.rows_by_key()
        starts, lengths = self.offsets[found], self.lengths[found]
        ends = starts + lengths
        k = 0
        while k < len(found):
            last = max(k + 1, int(np.searchsorted(ends, starts[k] + READ // self.width, "right")))
            base = int(starts[k])
            ids = self.ids(base, int(ends[last - 1]) - base)
            for i in range(k, last):
                a = int(starts[i]) - base
                yield int(found[i]), int(starts[i]), ids[a : a + int(lengths[i])]
            k = last

    def close(self) -> None:
        self.payload.close()


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about CHUNK bytes of text each, one row at least."""
    run = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)) // CHUNK
    first = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1, [len(run)]]) if len(run) else np.zeros(1, int)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        yield batch.slice(a, b - a)


def write_shards(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    end: int | None = 2,
    shard_bytes: int = 32 << 20,
    width: int = 2,
    kept_bytes: int | None = None,
) -> DataFrame:
    """Encode and write; returns one row a shard (SHARDS), already written. ``tokenizer`` is the path of a vocabulary
    file that every executor can read, ``width`` the bytes of an id, ``kept_bytes`` what a worker may remember of pieces
    (by itself ``pieces.KEPT_BYTES``); less takes more time and gives the same ids."""
    if width not in (2, 4):
        raise ValueError("an id takes 2 or 4 bytes")
    kind_of_id = docs.schema[doc_id].dataType.simpleString()
    if kind_of_id not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"ids of type {kind_of_id}: an index holds integer ids")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = max(1, -(-size // shard_bytes))
    # rows of one id can be more than a shard takes: their order goes on by the text and then by the place read
    order = ["id", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("k")]
    dealt = rows.select("id", "text", *order[1:]).repartitionByRange(shards, "id", "h", "k")
    dealt = dealt.sortWithinPartitions("id", "h", "k").select("id", "text")
    kind = "<u2" if width == 2 else "<u4"

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        uri = f"{folder}/shard-{task.partitionId():08d}"
        attempt = f"part-{task.taskAttemptId()}"
        keys: list[np.ndarray] = [np.zeros(0, np.int64)]
        lengths: list[np.ndarray] = [np.zeros(0, np.int64)]
        unnamed = 0

        def payload(stream) -> None:
            nonlocal unnamed
            model = encoder(tokenizer, kept_bytes)
            for batch in batches:
                # an id stays an integer: a null one is counted, not marked by a value
                unnamed += batch.column("id").null_count
                keys.append(pc.fill_null(batch.column("id"), 0).to_numpy(zero_copy_only=False))
                for some in _chunks(batch):
                    ids, n = model.encode(some.column("text"), end)
                    if len(ids) and int(ids.max()) >> (8 * width):
                        raise ValueError(f"an id does not fit in {width} bytes")
                    stream.write(ids.astype(kind).tobytes())
                    lengths.append(n)

        publish(f"{uri}.ids", attempt, payload)
        k, n = np.concatenate(keys), np.concatenate(lengths)
        publish(f"{uri}.idx", attempt, lambda stream: stream.write(index_bytes(k, n, width, unnamed)))
        named = k[unnamed:].tolist()
        first, last = (named[0], named[-1]) if named else (None, None)
        # a worker outlives its task, and what Arrow holds back would count against the stages after this one
        pa.default_memory_pool().release_unused()
        values = (task.partitionId(), uri, len(k), int(n.sum()), first, last)
        kinds = (pa.int32(), pa.string(), *[pa.int64()] * 4)
        names = ["shard", "uri", "rows", "n_ids", "first_id", "last_id"]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=names)

    return dealt.mapInArrow(written, SHARDS).checkpoint()


def placed(shards: DataFrame) -> DataFrame:
    """The shards with ``before``, the ids of all shards before each."""
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("before", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))


def read_documents(shards: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Every document from the files: id, start (ids before it in all), n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, before in zip(*(batch.column(c).to_pylist() for c in ("uri", "before")), strict=True):
                shard = Shard(uri)
                found = [(k, before + at, len(ids), zlib.crc32(ids.tobytes())) for k, at, ids in shard.documents()]
                shard.close()
                if not found:
                    continue
                row, start, n, crc = (np.array(c, np.int64) for c in zip(*found, strict=True))
                keys = pa.array(shard.keys[row], mask=row < shard.unnamed)
                yield pa.RecordBatch.from_arrays(
                    [keys, *map(pa.array, (start, n, crc))], names=[doc_id, "start", "n_tokens", "ids_crc32"]
                )

    full = placed(shards.where("rows > 0")).select("uri", "before")
    n = shards.sparkSession.sparkContext.defaultParallelism
    return full.repartition(n).mapInArrow(
        read, f"`{doc_id}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )


def lookup(shards: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """``key`` and its token ids for every key that is there, by one probe of the index of each shard it may be in."""
    near = wanted.select(F.col(key).cast("bigint").alias(key)).distinct().alias("w").join(
        shards.where("rows > 0").alias("s"), F.col(f"w.{key}").between(F.col("s.first_id"), F.col("s.last_id"))
    )

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, shard = None, None
        for batch in batches:
            keys, lists = [], []
            for uri, k in zip(*(batch.column(c).to_pylist() for c in ("uri", key)), strict=True):
                if uri != last:
                    if shard is not None:
                        shard.close()
                    last, shard = uri, Shard(uri)
                ids = shard.get(k)
                if ids is not None:
                    keys.append(k)
                    lists.append(ids.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], names=[key, "ids"]
            )

    asked = near.select("uri", f"w.{key}").repartition("uri").sortWithinPartitions("uri")
    return asked.mapInArrow(fetched, f"`{key}` bigint, ids array<bigint>")


def encoded(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Write ``docs`` to a new folder of the shared space and read every document back."""
    folder = scratch_uri(docs.sparkSession, "tokens")
    return read_documents(write_shards(docs, folder, tokenizer, doc_id, text, **options), doc_id)
