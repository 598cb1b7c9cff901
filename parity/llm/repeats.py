"""Windows that occur more than once: what the substring deduplications by words and by bytes have in common.

A *unit* is a word or a byte. Every window of ``width`` units is given an anchor, a place inside it that depends on
the window's content alone, so equal windows have equal anchors at equal offsets. Neighbouring windows with the same
anchor are one *record*: the name of the anchor, a fingerprint of the whole span of the record, and its windows. There
are many times fewer records than windows, and they are all that is shuffled of texts without repeats:

1. ``census``: one scan makes the records of every document. Equal records of a batch are combined first (they repeat
   each other, whatever else there is), the others are dealt out by name in packed rows. Where a name is met, a record
   whose whole span occurs again is repeated with all its windows; a record whose name occurs only once is not repeated
   at all; the rest is open. Records that a name has beside open ones are marked as partners.
2. Open records and one partner for each span are resolved window by window, by the method of the caller.
3. ``removed``: each document gets its repeated windows; what they cover is gone.

A frequent passage meets in packed rows, one for each batch of documents, and never as pairs. Rows of one id and text
share one set of findings, however many they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parity.llm import words
from parity.llm.keys import text_key

#: Fields of packed records.
FIELDS = (("name", np.uint64), ("span", np.uint64), ("id", np.int64), ("key", np.int64), ("at", np.uint32),
          ("n", np.uint32), ("offset", np.int32), ("many", np.uint8))
#: What is known of a record.
REPEATED, OPEN, PARTNER, CROWDED = 1, 2, 4, 8
FOUND = np.dtype([("at", "<u4"), ("n", "<u4"), ("state", "u1"), ("offset", "<i4"), ("name", "<u8")])
#: Windows met by their fingerprints. ``asks``: 0 a partner, 1 wants to know, 2 known to be repeated, 3 stands for more.
WINDOW_FIELDS = (("hash", np.uint64), ("check", np.uint64), ("id", np.int64), ("key", np.int64), ("at", np.uint32),
                 ("asks", np.uint8))
#: Fields of packed findings: those of FOUND and the document.
TOLD_FIELDS = (("id", np.int64), ("key", np.int64), ("at", np.uint32), ("n", np.uint32), ("state", np.uint8),
               ("offset", np.int32), ("name", np.uint64))
NO_ID = np.iinfo(np.int64).min

Records = dict[str, np.ndarray]
#: From encoded texts of a chunk: their number of units and their records (``text`` is the number of the text).
Anchoring = Callable[[list[bytes]], Records]


def rows_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id (null: NO_ID), key, text."""
    return docs.select(
        F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)).alias("id"), text_key(text).alias("key"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )


def buckets_for(rows: DataFrame, bytes_each: int = 64 << 20) -> int:
    """Number of buckets that names are dealt to: enough for the size of the texts."""
    size = rows.agg(F.sum(F.octet_length("text").cast("bigint")).alias("n")).first()["n"] or 0
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // bytes_each))


def groups(changes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the groups of n sorted rows, from where a row differs from the one before it."""
    starts = np.concatenate([np.zeros(min(n, 1), np.int64), np.flatnonzero(changes) + 1])
    return starts, np.append(starts[1:], n)[: len(starts)]


def packed(rec: Records, bucket: np.ndarray, fields) -> pd.DataFrame:
    """One row for each bucket with the bytes of each field."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cuts, ends = groups(b[1:] != b[:-1], len(b))
    out = {"bucket": b[cuts].astype(np.int32)}
    for name, kind in fields:
        values = rec[name].astype(kind)[order]
        out[name] = [values[i:j].tobytes() for i, j in zip(cuts, ends, strict=True)]
    return pd.DataFrame(out)


def unpacked(batches: Iterator[pd.DataFrame], fields) -> Records:
    parts: dict[str, list[bytes]] = {name: [] for name, _ in fields}
    for batch in batches:
        for name, _ in fields:
            parts[name] += list(batch[name])
    return {name: np.frombuffer(b"".join(parts[name]), kind) for name, kind in fields}


def schema_of(fields) -> str:
    return "bucket int, " + ", ".join(f"{name} binary" for name, _ in fields)


def combined(rec: Records) -> Records:
    """One finding for each place of a document, with all that is known of it: equal rows find the same."""
    order = np.lexsort((rec["at"], rec["key"], rec["id"]))
    i, k, at = rec["id"][order], rec["key"][order], rec["at"][order]
    starts, _ = groups((i[1:] != i[:-1]) | (k[1:] != k[:-1]) | (at[1:] != at[:-1]), len(i))
    states = np.bitwise_or.reduceat(rec["state"][order], starts) if len(starts) else rec["state"]
    return {**{name: rec[name][order[starts]] for name, _ in TOLD_FIELDS}, "state": states}


def told(out: Records, buckets: int) -> pd.DataFrame:
    """What is known of records, packed by the bucket of their document."""
    out = combined(out)
    return packed(out, (out["key"].astype(np.int64).view(np.uint64) % np.uint64(buckets)).astype(np.int32), TOLD_FIELDS)


def assembled(told_rows: DataFrame, buckets: int) -> DataFrame:
    """id, key, found, repeats, needs: one row for each document that something is known of."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rec = unpacked(batches, TOLD_FIELDS)
        if not len(rec["id"]):
            return
        rec = combined(rec)
        i, k = rec["id"], rec["key"]
        found = np.zeros(len(i), FOUND)
        for name in FOUND.names:
            found[name] = rec[name]
        starts, ends = groups((i[1:] != i[:-1]) | (k[1:] != k[:-1]), len(i))
        states = np.bitwise_or.reduceat(found["state"], starts)
        for at in range(0, len(starts), 10_000):
            a, b = starts[at : at + 10_000], ends[at : at + 10_000]
            s = states[at : at + 10_000]
            yield pd.DataFrame({
                "id": i[a], "key": k[a], "found": [found[x:y].tobytes() for x, y in zip(a, b, strict=True)],
                "repeats": (s & REPEATED) > 0, "needs": (s & (OPEN | PARTNER)) > 0,
            })

    dealt = told_rows.repartition(buckets, "bucket")
    return dealt.mapInPandas(gather, "id bigint, key bigint, found binary, repeats boolean, needs boolean")


def census(rows: DataFrame, anchoring: Anchoring, buckets: int, crowd: int = 1 << 30) -> DataFrame:
    """id, key, found: what is known of the records of each document (those that occur once are left out); repeats and
    needs: whether a row holds repeated records, and records to resolve. Records to resolve whose name has more than ``crowd`` different spans are marked as CROWDED."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, keys = batch["id"].to_numpy(np.int64), batch["key"].to_numpy(np.int64)
            found: list[Records] = []
            for first, parts in words.chunks(list(batch["text"])):
                rec = anchoring(parts)
                rec["id"], rec["key"] = ids[first + rec["text"]], keys[first + rec["text"]]
                found.append(rec)
            rec = {k: np.concatenate([r[k] for r in found]) for k, _ in FIELDS if k != "many"} if found else None
            if rec is None or not len(rec["name"]):
                continue
            order = np.lexsort((rec["span"], rec["name"]))
            same = (rec["name"][order][1:] == rec["name"][order][:-1]) & (rec["span"][order][1:] == rec["span"][order][:-1])
            again = np.zeros(len(order), bool)
            again[1:] = same
            many = again.copy()
            many[:-1] |= same
            again_of, many_of = np.zeros_like(again), np.zeros_like(many)
            again_of[order], many_of[order] = again, many
            rec["many"] = many_of
            # 0: repeated in this batch already, nothing more to learn; 1: to be met with the others of its name
            kind = np.where(again_of, 0, 1)
            own = {k: v[kind == 1] for k, v in rec.items()}
            yield packed(own, (own["name"] % np.uint64(buckets)).astype(np.int32), FIELDS)
            if (kind == 0).any():
                done = {k: v[kind == 0] for k, v in rec.items()}
                done = combined({**done, "state": np.full(len(done["name"]), REPEATED, np.uint8)})
                done["span"] = done["name"]
                done["many"] = np.full(len(done["name"]), 2, np.uint8)
                yield packed(done, (done["key"].view(np.uint64) % np.uint64(buckets)).astype(np.int32), FIELDS)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rec = unpacked(batches, FIELDS)
        if not len(rec["name"]):
            return
        done = rec["many"] == 2
        out = [{**{k: rec[k][done] for k in ("id", "key", "at", "n", "offset", "name")}, "state": np.full(done.sum(), REPEATED, np.uint8)}]
        rec = {k: v[~done] for k, v in rec.items()}
        order = np.lexsort((rec["span"], rec["name"]))
        rec = {k: v[order] for k, v in rec.items()}
        name, span = rec["name"], rec["span"]
        if len(name):
            new_name = np.concatenate([[True], name[1:] != name[:-1]])
            new_span = new_name | np.concatenate([[True], span[1:] != span[:-1]])
            of_span = np.cumsum(new_span) - 1
            of_name = np.cumsum(new_name) - 1
            repeated = (np.bincount(of_span) > 1)[of_span] | (np.bincount(of_span, weights=rec["many"]) > 0)[of_span]
            spans = np.bincount(of_name, weights=new_span)[of_name]
            is_open = ~repeated & (spans > 1)
            any_open = (np.bincount(of_name, weights=is_open) > 0)[of_name]
            partner = repeated & new_span & any_open
            state = REPEATED * repeated + OPEN * is_open + PARTNER * partner
            state = (state + CROWDED * ((is_open | partner) & (spans > crowd))).astype(np.uint8)
            keep = state > 0
            out.append({**{k: rec[k][keep] for k in ("id", "key", "at", "n", "offset", "name")}, "state": state[keep]})
        yield told({k: np.concatenate([o[k] for o in out]) for k in out[0]}, buckets)

    dealt = rows.mapInPandas(scan, schema_of(FIELDS)).repartition(buckets, "bucket")
    return assembled(dealt.mapInPandas(meet, schema_of(TOLD_FIELDS)), buckets)


def by_document(found: DataFrame) -> DataFrame:
    """One row for each document; its parts are bounded by its length."""
    return found.groupBy("id", "key").agg(F.collect_list("found").alias("found"))


def with_found(rows: DataFrame, found: DataFrame, how: str) -> DataFrame:
    return rows.join(by_document(found), ["id", "key"], how)


def entries(parts) -> np.ndarray:
    return np.frombuffer(b"".join(parts), FOUND) if parts is not None and len(parts) else np.zeros(0, FOUND)


def covered(found: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of the n units the repeated windows cover."""
    steps = np.zeros(n + 1, np.int64)
    found = found[(found["state"] & REPEATED) > 0]
    np.add.at(steps, found["at"], 1)
    np.add.at(steps, found["at"].astype(np.int64) + found["n"] - 1 + width, -1)
    return np.cumsum(steps)[:n] > 0


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    steps = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def records(anchor: np.ndarray, start: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window (an index into the arrays) and number of windows of each run of windows that follow each other in
    one text and share an anchor."""
    if not len(anchor):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(anchor)))


def dealt_windows(rec: Records, buckets: int) -> Iterator[pd.DataFrame]:
    """Packed windows by the bucket of their fingerprint; those that repeat each other in ``rec`` go as one."""
    order = np.lexsort((rec["check"], rec["hash"]))
    h, c = rec["hash"][order], rec["check"][order]
    same = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
    again, more = np.zeros(len(order), bool), np.zeros(len(order), bool)
    again[order[1:]] = same
    more[order[:-1]] = same
    asks = rec["asks"]
    known = again & (asks == 1)
    first = ~again
    asks = np.where(first & more, 3, asks).astype(np.uint8)
    met = {**{k: v[first] for k, v in rec.items()}, "asks": asks[first]}
    yield packed(met, (met["hash"] % np.uint64(buckets)).astype(np.int32), WINDOW_FIELDS)
    if known.any():
        done = {**{k: v[known] for k, v in rec.items()}, "asks": np.full(known.sum(), 2, np.uint8)}
        yield packed(done, (done["key"].view(np.uint64) % np.uint64(buckets)).astype(np.int32), WINDOW_FIELDS)


def met_windows(batches: Iterator[pd.DataFrame], buckets: int) -> Iterator[pd.DataFrame]:
    rec = unpacked(batches, WINDOW_FIELDS)
    if not len(rec["hash"]):
        return
    done = np.flatnonzero(rec["asks"] == 2)
    open_ = np.flatnonzero(rec["asks"] != 2)
    order = open_[np.lexsort((rec["check"][open_], rec["hash"][open_]))]
    h, c = rec["hash"][order], rec["check"][order]
    same = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
    again = rec["asks"][order] == 3
    again[1:] |= same
    again[:-1] |= same
    hit = np.concatenate([done, order[again & (rec["asks"][order] > 0)]])
    yield singles(rec["id"][hit], rec["key"][hit], rec["at"][hit], buckets)


def meeting_windows(dealt: DataFrame, buckets: int) -> DataFrame:
    """The windows that want to know and occur again, one row for each document."""
    meet = dealt.repartition(buckets, "bucket").mapInPandas(lambda rows: met_windows(rows, buckets), schema_of(TOLD_FIELDS))
    return assembled(meet, buckets)


def singles(ids: np.ndarray, keys: np.ndarray, at: np.ndarray, buckets: int) -> pd.DataFrame:
    """Repeated windows, one by one."""
    n = len(ids)
    return told({
        "id": ids, "key": keys, "at": at, "n": np.ones(n, np.uint32), "state": np.full(n, REPEATED, np.uint8),
        "offset": np.zeros(n, np.int32), "name": np.zeros(n, np.uint64),
    }, buckets)
