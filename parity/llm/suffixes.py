"""Substring deduplication by bytes, by suffix sorting in buckets with a difference cover.

A suffix matters here by its first ``width`` bytes (a window). Suffixes are put in buckets by the anchor of their
window, the smallest hash among its ``GRAM``-byte strings, and by the place of the anchor; equal windows share a
bucket. Records of neighbouring suffixes with one anchor are sorted out first by their whole spans (see ``repeats``).
What stays open is sorted, in Spark tasks that hold the contexts of their buckets and take one block of buckets at a
time:

* the cover sample, all places whose distance from the anchor is in a difference cover modulo ``PERIOD``, gets ranks of
  its ``LONG`` bytes by doubling: 31, 62, 124 and 155 bytes;
* the suffixes of a block are sorted by their first bytes; ties that go on are resolved by the precomputed rank of the
  next sample place, and by the bytes after it. Suffixes that fall out alone leave the sort at once.

So no comparison is longer than a few words and memory is bounded by a block, however long the ties. The texts are
compared byte by byte. Buckets with more than ``crowd`` different contexts (the ends of a passage in very many
documents) are not gathered at all: their windows are dealt out one by one by 128-bit fingerprints, equal ones combined
before the shuffle.

Defined results: null and empty texts have no bytes. A text shorter than a window keeps all. Repeated rows repeat each
other. Null ids keep their rows. Other columns play no part. Places are cut between bytes, so the kept bytes of a text
need not be valid UTF-8; they are a binary column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from parity.llm import repeats, words
from parity.llm.repeats import CROWDED, NO_ID, OPEN, PARTNER

GRAM = 64
PERIOD = 31
LONG = 5 * PERIOD
#: Bytes of text handled at a time by a scan, and suffixes of a block.
CHUNK, BLOCK = 1 << 18, 1 << 18
CONTEXT_FIELDS = (("name", np.uint64), ("offset", np.int32), ("n", np.uint32), ("id", np.int64), ("key", np.int64),
                  ("at", np.uint32), ("asks", np.uint8))


def difference_cover(period: int) -> np.ndarray:
    """Residues whose differences give every residue, chosen greedily."""
    cover, covered = [0], {0}
    while len(covered) < period:
        def gain(c: int) -> int:
            return len({(c - x) % period for x in cover} | {(x - c) % period for x in cover} | covered)

        cover.append(max((c for c in range(period) if c not in cover), key=gain))
        covered = {(a - b) % period for a in cover for b in cover}
    return np.array(sorted(cover))


def sliding_smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchoring(width: int):
    def run(parts: list[bytes]) -> repeats.Records:
        found = [r for first, some in _bounded(parts) for r in [_anchored(some, first, width)] if r is not None]
        empty = np.zeros(0, np.int64)
        if not found:
            return {"name": np.zeros(0, np.uint64), "span": np.zeros(0, np.uint64), "text": empty, "at": empty, "n": empty, "offset": empty}
        return {k: np.concatenate([f[k] for f in found]) for k in found[0]}

    return run


def _bounded(parts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    first, some, size = 0, [], 0
    for i, part in enumerate(parts):
        if some and size + len(part) > CHUNK:
            yield first, some
            first, some, size = i, [], 0
        some.append(part)
        size += len(part) + 1
    if some:
        yield first, some


def _anchored(parts: list[bytes], first: int, width: int) -> repeats.Records | None:
    buffer = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    lengths = np.array([len(p) for p in parts])
    begin = np.cumsum(lengths + 1) - lengths - 1
    windows = np.maximum(lengths - width + 1, 0)
    if not windows.any():
        return None
    owner = np.repeat(np.arange(len(parts)), windows)
    at = np.arange(len(owner)) - (np.cumsum(windows) - windows)[owner] + begin[owner]
    prefix = words.prefix_hashes(words.byte_values(buffer))
    places = np.arange(len(buffer) - GRAM + 1)
    grams = words.range_hashes(prefix, places, places + GRAM)
    # the order of grams: their leading bits, then the place
    bits = np.uint64(max(1, int(len(grams)).bit_length()))
    ordered = ((grams >> bits) << bits) | places.astype(np.uint64)
    smallest = sliding_smallest(ordered, width - GRAM + 1)[at]
    anchor = (smallest & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    head, many = repeats.records(anchor, at, owner)
    s0, a = at[head], anchor[head]
    offset = a - s0
    span = words.range_hashes(prefix, s0, s0 + many - 1 + width)
    span = words.mix(span + offset.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + many.astype(np.uint64))
    text = owner[head]
    return {"name": grams[a], "span": span, "text": text + first, "at": s0 - begin[text], "n": many, "offset": offset}


# ---- sorting the suffixes of open records


def _refined(group: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Numbers of the classes of equal (group, key), in their order."""
    order = np.lexsort((keys, group))
    g, k = group[order], keys[order]
    new = np.zeros(len(order), np.int64)
    new[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def repeated_suffixes(
    text: np.ndarray, base: np.ndarray, name: np.ndarray, offset: np.ndarray, n: np.ndarray, width: int
) -> np.ndarray:
    """For every suffix of every context (``n`` of them each, from its start at ``base``) whether another suffix of its
    bucket begins with the same ``width`` bytes."""
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    word = np.zeros(len(text) + 8, np.uint64)
    for k in range(8):
        word |= padded[k : k + len(word)].astype(np.uint64) << np.uint64(8 * (7 - k))
    total = int(n.sum())
    owner = np.repeat(np.arange(len(base)), n)
    step = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    place = base[owner] + step
    distance = offset[owner] - step  # from the suffix to its anchor
    cover = difference_cover(PERIOD)

    # the cover sample of all contexts, and its ranks
    length = n + width - 1
    of = np.repeat(np.arange(len(base)), length)
    inner = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    taken = np.zeros(PERIOD, bool)
    taken[cover] = True
    chosen = taken[(inner - offset[of]) % PERIOD] & (inner + PERIOD <= length[of])
    sample = (base[of] + inner)[chosen]
    index = np.full(len(text) + 1, -1, np.int64)
    index[sample] = np.arange(len(sample))
    rank = np.zeros(len(sample), np.int64)
    for k in (0, 8, 16):
        rank = _refined(rank, word[sample + k])
    short = _refined(rank, word[sample + 24] >> np.uint64(8))  # the last of 31 bytes
    ranks = short
    reach = PERIOD
    for more in (PERIOD, 2 * PERIOD, 4 * PERIOD):
        other = index[np.minimum(sample + reach, len(text))]
        follow = short if more == 4 * PERIOD else ranks
        # at the end of a context there is nothing to follow; such ranks are never asked for
        ranks = _refined(ranks, np.where(other >= 0, follow[other], -1))
        reach += PERIOD if more == 4 * PERIOD else more
    assert reach == LONG

    ahead = np.array([min((c - r) % PERIOD for c in cover.tolist()) for r in range(PERIOD)])
    next_sample = place + ahead[(-distance) % PERIOD]
    group = _refined(_refined(np.zeros(total, np.int64), name[owner]), distance)
    live = np.arange(total)
    keys = [lambda p, k=k: word[place[p] + k] for k in (0, 8, 16, 24)]
    keys.append(lambda p: ranks[index[next_sample[p]]])
    keys += [lambda p, k=k: word[place[p] + k] for k in range(LONG - LONG % 8, width - 7, 8)]
    if width % 8:
        keys.append(lambda p: word[place[p] + width - 8])
    out = np.zeros(total, bool)
    group = group[live]
    for key in [None, *keys]:
        if key is not None:
            group = _refined(group, key(live))
        many = np.bincount(group)[group] > 1
        live, group = live[many], group[many]
        if not len(live):
            return out
    out[live] = True
    return out


def resolved(rows: DataFrame, found: DataFrame, width: int, buckets: int) -> DataFrame:
    """The suffixes of open records that occur again, as id, key, found."""
    asked = repeats.with_found(rows, found.where("needs").select("id", "key", "found"), "inner")

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, size = [], 0
            for i, k, t, f in zip(batch["id"], batch["key"], batch["text"], batch["found"], strict=True):
                rec = repeats.entries(f)
                rec = rec[((rec["state"] & (OPEN | PARTNER)) > 0) & ((rec["state"] & CROWDED) == 0)]
                data = t.encode("utf-8", "surrogatepass")
                for r in rec.tolist():
                    at, n, state, offset, name = r
                    out.append((name, offset, n, i, k, at, int(state & OPEN > 0), data[at : at + n - 1 + width]))
                    size += n + width
                if size > CHUNK * 8:
                    yield _packed_contexts(out, buckets)
                    out, size = [], 0
            if out:
                yield _packed_contexts(out, buckets)

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = list(batches)
        if not sum(map(len, rows)):
            return
        rec = repeats.unpacked(iter(rows), CONTEXT_FIELDS)
        text = np.frombuffer(b"".join(x for r in rows for x in r["context"]), np.uint8)
        length = rec["n"].astype(np.int64) + width - 1
        base = np.cumsum(length) - length
        order = np.argsort(rec["name"], kind="stable")
        names = rec["name"][order]
        ends = np.append(np.flatnonzero(names[1:] != names[:-1]) + 1, len(names))
        work = np.cumsum(rec["n"][order].astype(np.int64))
        a = 0
        while a < len(order):
            # as many whole buckets as a block takes, one at least
            limit = (work[a - 1] if a else 0) + BLOCK
            b = int(ends[max(np.searchsorted(ends, np.searchsorted(work, limit, "right"), "right") - 1, np.searchsorted(ends, a, "right"))])
            part = order[a:b]
            cut = np.concatenate([text[base[r] : base[r] + length[r]] for r in part])
            n = rec["n"][part].astype(np.int64)
            own = np.cumsum(length[part]) - length[part]
            hit = repeated_suffixes(cut, own, rec["name"][part], rec["offset"][part].astype(np.int64), n, width)
            owner = np.repeat(part, n)
            step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            hit &= rec["asks"][owner] > 0
            if hit.any():
                yield repeats.singles(rec["id"][owner[hit]], rec["key"][owner[hit]], rec["at"][owner[hit]] + step[hit], buckets)
            a = b

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[repeats.Records] = []
            for i, k, t, f in zip(batch["id"], batch["key"], batch["text"], batch["found"], strict=True):
                rec = repeats.entries(f)
                rec = rec[(rec["state"] & CROWDED) > 0]
                if not len(rec):
                    continue
                values = words.byte_values(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8))
                one, two = words.prefix_hashes(values), words.prefix_hashes(words.mix(values))
                n = rec["n"].astype(np.int64)
                at = np.repeat(rec["at"].astype(np.int64) - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                out.append({
                    "hash": words.range_hashes(one, at, at + width), "check": words.range_hashes(two, at, at + width),
                    "id": np.full(len(at), i), "key": np.full(len(at), k), "at": at,
                    "asks": np.repeat((rec["state"] & OPEN) > 0, n).astype(np.uint8),
                })
            if out:
                yield from repeats.dealt_windows({k: np.concatenate([o[k] for o in out]) for k in out[0]}, buckets)

    def both(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for kind, part in ((0, contexts(iter([batch]))), (1, windows(iter([batch])))):
                for rows in part:
                    yield rows.assign(kind=kind).reindex(columns=columns)

    fields = dict(CONTEXT_FIELDS) | dict(repeats.WINDOW_FIELDS)
    columns = ["kind", "bucket", *fields, "context"]
    schema = "kind int, bucket int, " + ", ".join(f"{f} binary" for f in fields) + ", context binary"
    # the texts are joined once for both ways
    dealt = asked.mapInPandas(both, schema).repartition(buckets, "bucket")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        crowded: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch[batch["kind"] == 0])
            crowded.append(batch[batch["kind"] == 1])
        yield from sort(iter(held))
        if sum(map(len, crowded)):
            yield from repeats.met_windows(iter(crowded), buckets)

    return repeats.assembled(dealt.mapInPandas(meet, repeats.schema_of(repeats.TOLD_FIELDS)), buckets)


def _packed_contexts(rows: list[tuple], buckets: int) -> pd.DataFrame:
    names = [f for f, _ in CONTEXT_FIELDS]
    rec = {f: np.array([r[k] for r in rows], kind) for k, (f, kind) in enumerate(CONTEXT_FIELDS)}
    bucket = (rec["name"] % np.uint64(buckets)).astype(np.int32)
    out = repeats.packed(rec, bucket, CONTEXT_FIELDS)
    texts: dict[int, list[bytes]] = {}
    for b, r in zip(bucket.tolist(), rows, strict=True):
        texts.setdefault(b, []).append(r[len(names)])
    return out.assign(context=[b"".join(texts[b]) for b in out["bucket"].tolist()])


def repeated_windows(rows: DataFrame, width: int, crowd: int = 4096) -> DataFrame:
    """id, key, found: the repeated windows of each document that has some."""
    buckets = repeats.buckets_for(rows)
    known = repeats.census(rows, anchoring(width), buckets, crowd).checkpoint()
    return known.where("repeats").select("id", "key", "found").union(
        resolved(rows, known, width, buckets).select("id", "key", "found")
    )


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 200, crowd: int = 4096) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept (binary) of every row."""
    if width < LONG + PERIOD:
        raise ValueError(f"a window has at least {LONG + PERIOD} bytes")
    rows = repeats.rows_of(docs, doc_id, text)
    found = repeated_windows(rows, width, crowd)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t, f in zip(batch["text"], batch["found"], strict=True):
                data = t.encode("utf-8", "surrogatepass")
                starts, ends = repeats.runs(repeats.covered(repeats.entries(f), width, len(data)))
                edges = [0, *np.stack([starts, ends], 1).ravel().tolist(), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(data), len(data) - len(kept), len(starts), kept))
            ids = pd.array(batch["id"].to_numpy(np.int64), dtype="Int64")
            ids[batch["id"].to_numpy(np.int64) == NO_ID] = pd.NA
            frame = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept"])
            frame.insert(0, doc_id, ids)
            yield frame

    joined = repeats.with_found(rows, found, "left").select("id", "text", "found")
    return joined.mapInPandas(cut, f"`{doc_id}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
