"""Chat logs folded into messages and rendered as training text with a loss mask.

A log is a table of events: a conversation, the message an event belongs to, its place in the message, a kind, a role
and a text. ``message`` and ``start`` open a message (whole, or empty and to be streamed), ``delta`` appends, ``edit``
replaces the text, ``regenerate`` throws it away so that the deltas after it begin anew. Events are sorted by
conversation, message and place and folded in one pass.

A turn is rendered as ``### role: text</turn>`` and a line end. What could be read as a mark is escaped with a
backslash, so that neither ``###`` nor ``</turn>`` ever stands inside a rendered text, and the reading back is exact:

    backslash  two backslashes        </turn>  <\\/turn>
    #          backslash and #, in runs of three or more; a colon of a role likewise

On Spark: one range shuffle by conversation and message. The order goes on inside a conversation, so one that holds a
third of all events is spread over as many tasks as its share. Tasks stream: they hold one message and the segment they
write (about ``SEGMENT`` characters, a turn at least). A segment that is a conversation of its own is digested where it
is read; only conversations that go on in another segment are shuffled for that, compressed in their segments, and
hashed in order as a stream (a digest of a whole conversation is sequential by nature).

Defined results: null texts and roles are empty, a null kind is ``message``, events of unknown kinds are left out. A
delta, edit or regenerate before any opening opens the message itself. Rows without a conversation are one conversation
without an id. Events that agree in everything are kept. An empty table gives no rows. Other columns are left out. A
message must fit in a worker's memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parity.llm.files import scratch_uri

#: Characters of a segment, after which the next turn begins another one.
SEGMENT = 1 << 20
#: Role whose texts are learned.
LEARNED = "assistant"
OPEN, CLOSE = "### ", "</turn>\n"
_HASHES = re.compile("#{3,}")
_ROLE = re.compile(r"(?:[^\\:]|\\.)*", re.DOTALL)
_ESCAPED = re.compile(r"\\([\\#/:])")


def escaped(text: str) -> str:
    if "\\" in text:
        text = text.replace("\\", "\\\\")
    if "</turn>" in text:
        text = text.replace("</turn>", "<\\/turn>")
    if "###" in text:
        text = _HASHES.sub(lambda m: "\\#" * len(m[0]), text)
    return text


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def rendered(role: str, text: str) -> tuple[str, int, int]:
    """(turn as text, start and end of the text in it)."""
    head = f"{OPEN}{escaped(role).replace(':', chr(92) + ':')}: "
    body = escaped(text)
    return f"{head}{body}{CLOSE}", len(head), len(head) + len(body)


def turns(formatted: str) -> Iterator[tuple[str, str]]:
    """The (role, text) of every rendered turn."""
    at = 0
    while at < len(formatted):
        end = formatted.index(CLOSE, at)
        mark = _ROLE.match(formatted, at + len(OPEN)).end()
        yield unescaped(formatted[at + len(OPEN) : mark]), unescaped(formatted[mark + 2 : end])
        at = end + len(CLOSE)


def folded(events: Iterator[tuple]) -> Iterator[tuple]:
    """(conversation, role, text) of each message; events are (conversation, message, kind, role, text) in order."""
    now = role = None
    parts: list[str] | None = None
    for conv, message, kind, who, text in events:
        if parts is not None and (conv, message) != now:
            yield now[0], role, "".join(parts)
            parts = None
        if kind in ("message", "start"):
            if parts is not None:
                yield now[0], role, "".join(parts)
            parts, role = [text], who
        elif kind == "delta" and parts is not None:
            parts.append(text)
        elif kind in ("edit", "regenerate", "delta"):
            role = who if parts is None else role
            parts = [text]
        else:
            continue
        now = (conv, message)
    if parts is not None:
        yield now[0], role, "".join(parts)


def formatted(
    events: DataFrame,
    conv: str,
    message: Sequence[str],
    place: str,
    kind: str,
    role: str,
    text: str,
) -> DataFrame:
    """Segments: conversation, segment (ascending within a conversation), text, the starts and ends of what is learned,
    turns, and whether it is all of its conversation. ``message`` are the columns that order and name the messages."""
    conv_kind = events.schema[conv].dataType.simpleString()
    order = [F.col(conv).alias("conv"), F.struct(*message).alias("message"), F.col(place).alias("place")]
    rows = events.select(
        *order,
        F.coalesce(F.col(kind), F.lit("message")).alias("kind"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.xxhash64(text).alias("tie"),
    )
    dealt = rows.repartitionByRange("conv", "message").sortWithinPartitions("conv", "message", "place", "tie")
    names = dealt.select("conv", F.to_json("message").alias("message"), "kind", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        events = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        parts, starts, ends, size = [], [], [], 0
        ready: list[tuple] = []
        held = 0  # characters that are ready
        first = True  # the partition's first conversation may have begun in the one before
        alone, now, open_ = False, None, False

        def segment(whole: bool) -> None:
            nonlocal parts, starts, ends, size, number, held
            held += size
            ready.append((now, number, "".join(parts), starts, ends, len(parts), whole))
            parts, starts, ends, size = [], [], [], 0
            number += 1

        for conv_id, who, said in folded(events):
            if open_ and conv_id != now:
                if parts:
                    segment(alone and not first)
                first, open_ = False, False
            if not open_:
                now, open_, alone = conv_id, True, True
            elif size >= SEGMENT:
                alone = False
                segment(False)
            turn, start, end = rendered(who, said)
            if who == LEARNED:
                starts.append(size + start)
                ends.append(size + end)
            parts.append(turn)
            size += len(turn)
            if held > 4 * SEGMENT or len(ready) >= 4096:
                yield table(ready)
                ready, held = [], 0
        if parts:
            segment(False)
        if ready:
            yield table(ready)

    schema = f"conv {conv_kind}, segment bigint, text string, starts array<bigint>, ends array<bigint>, turns bigint, whole boolean"
    types = [pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.bool_()]
    conv_type = pa.string() if conv_kind == "string" else pa.int32() if conv_kind == "int" else pa.int64()

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, [conv_type, *types], strict=True)],
            names=["conv", "segment", "text", "starts", "ends", "turns", "whole"],
        )

    return names.mapInArrow(run, schema)


def read_back(segments: DataFrame) -> DataFrame:
    """One row a conversation, from the written segments alone: n_turns, turns_sha256 (role, line end, text, line end of
    each turn), loss_chars and loss_sha256 (all learned text), formatted_chars."""
    conv_kind = segments.schema["conv"].dataType.simpleString()
    conv_type = pa.string() if conv_kind == "string" else pa.int32() if conv_kind == "int" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        out: list[tuple] = []

        def closed() -> tuple:
            n, chars, loss, said, learned = state
            return now, n, said.hexdigest(), loss, learned.hexdigest(), chars

        for batch in batches:
            for conv_id, text, starts, ends in zip(*(batch.column(c).to_pylist() for c in
                                                     ("conv", "text", "starts", "ends")), strict=True):
                if state is None or conv_id != now:
                    if state is not None:
                        out.append(closed())
                    now, state = conv_id, [0, 0, 0, hashlib.sha256(), hashlib.sha256()]
                for who, said in turns(text):
                    state[0] += 1
                    state[3].update(f"{who}\n{said}\n".encode())
                state[1] += len(text)
                for a, b in zip(starts, ends, strict=True):
                    learned = unescaped(text[a:b])
                    state[2] += len(learned)
                    state[4].update(learned.encode())
            if out:
                yield digests(out)
                out = []
        if state is not None:
            yield digests([closed()])

    def digests(rows: list[tuple]) -> pa.RecordBatch:
        types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = f"conv {conv_kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    parts = segments.select("conv", "segment", "text", "starts", "ends", "whole")
    alone = parts.where("whole").mapInArrow(run, schema)
    shared = parts.where("not whole").repartition("conv").sortWithinPartitions("conv", "segment").mapInArrow(run, schema)
    return alone.unionByName(shared)


def written(segments: DataFrame) -> DataFrame:
    """The segments, written to the shared folder and read again."""
    spark = segments.sparkSession
    uri = scratch_uri(spark, "chat")
    segments.write.option("compression", "zstd").parquet(uri)
    return spark.read.parquet(uri)


def log_of_turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """A table of finished turns as the log a chat service would have kept: what the assistant says comes in two
    deltas, everything else at once. Repeated rows are messages of their own."""
    known = rows.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).withColumns({"h": F.xxhash64("role", "text"), "row": F.monotonically_increasing_id()})

    def event(kind: str, said: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), said.alias("text"))

    streamed = F.array(
        event("start", F.lit("")),
        event("delta", F.expr("left(text, int(floor(length(text) / 2)))")),
        event("delta", F.expr("substr(text, int(floor(length(text) / 2)) + 1)")),
    )
    events = F.when(F.col("role") == LEARNED, streamed).otherwise(F.array(event("message", F.col("text"))))
    return known.select("conv_id", "turn", "role", "h", "row", F.posexplode(events).alias("place", "event")).select(
        "conv_id", "turn", "role", "h", "row", "place", "event.kind", "event.text"
    )
