"""Substring deduplication by words, by recompression.

The words of a text are symbols. A round of recompression first names every run of one symbol, then parts the alphabet
in two by a bit of each symbol and names every pair of a left and a right symbol. Names are hashes of what they stand
for, so all tasks name alike and no table of names has to be shuffled between rounds. After ``ROUNDS`` rounds equal
passages consist of equal symbols, except near their ends. How near is tracked for each symbol: its *context* is the
range of words that decided it, and a symbol whose context lies inside a passage is there in every copy of the
passage.

The anchor of a window is the smallest of the symbols whose contexts lie inside the window. Windows that share an
anchor form records, which Spark groups by the name of the anchor (the symbol together with its context): shared
symbols reveal candidates, and spans or single windows with equal fingerprints verify them, with 128 bits for a window
(see ``repeats``). A window without such a symbol, as in one long run, is its own anchor.

Defined results: a null or empty text has no words and keeps the empty text. A text shorter than a window keeps all.
Repeated rows repeat each other: texts of a window or more go altogether. Null ids keep their rows. Other columns play
no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parity.llm import repeats, words
from parity.llm.repeats import NO_ID, OPEN, PARTNER

ROUNDS = 3


def _u(x: int) -> np.uint64:
    return np.uint64(x & 0xFFFFFFFFFFFFFFFF)


def recompress(symbols: np.ndarray, text: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, first word, start and end of the context) of the symbols after some rounds. ``text`` numbers the text of
    each word; the context of a symbol next to the end of a text reaches beyond the text."""
    n = len(symbols)
    first, end = np.arange(n), np.arange(1, n + 1)
    left, right = first.copy(), end.copy()
    for r in range(rounds):
        for step in ("runs", "pairs"):
            m = len(symbols)
            if not m:
                return symbols, first, left, right
            linked = text[1:] == text[:-1]
            if step == "runs":
                joined = linked & (symbols[1:] == symbols[:-1])
            else:
                side = (words.mix(symbols + _u(0x632BE59BD9B4E019 * (r + 1))) >> np.uint64(63)).astype(bool)
                joined = linked & ~side[:-1] & side[1:]
            heads = np.flatnonzero(np.concatenate([[True], ~joined]))
            tails = np.append(heads[1:], m) - 1
            # what decided a symbol now: itself and its two neighbours before this step
            before, after = np.maximum(heads - 1, 0), np.minimum(tails + 1, m - 1)
            edge_l = (heads == 0) | (text[before] != text[heads])
            edge_r = (tails == m - 1) | (text[after] != text[tails])
            new_left = np.where(edge_l, first[heads] - 1, left[before])
            new_right = np.where(edge_r, end[tails] + 1, right[after])
            # a symbol at the edge stays out of reach
            new_left = np.minimum(new_left, left[heads])
            new_right = np.maximum(new_right, right[tails])
            size = tails - heads
            named = symbols[heads]
            if step == "runs":
                name = words.mix(named ^ _u(0xD6E8FEB86659FD93 * (2 * r + 1)) + size.astype(np.uint64))
            else:
                name = words.mix(words.mix(named + _u(0xA0761D6478BD642F * (2 * r + 1))) ^ symbols[tails])
            symbols = np.where(size > 0, name, named)
            first, end, left, right, text = first[heads], end[tails], new_left, new_right, text[heads]
    return symbols, first, left, right


def anchoring(width: int):
    def run(parts: list[bytes]) -> repeats.Records:
        buffer, starts, ends, first = words.word_bounds(parts)
        empty = np.zeros(0, np.int64)
        n = len(starts)
        counts = np.diff(first)
        owner = np.repeat(np.arange(len(parts)), counts)
        level0 = words.word_hashes(buffer, starts, ends) if n else np.zeros(0, np.uint64)
        at = np.flatnonzero(np.arange(n) + width <= first[1:][owner]) if n else empty
        if not len(at):
            return {"name": np.zeros(0, np.uint64), "span": np.zeros(0, np.uint64), "text": empty, "at": empty, "n": empty, "offset": empty}
        symbols, _, left, right = recompress(level0, owner)
        low = np.searchsorted(left, at, "left")
        high = np.searchsorted(right, at + width, "right") - 1
        order = words.mix(symbols)
        best = low.copy()
        none = low > high
        best[none] = -1
        live = np.flatnonzero(high > low)
        k = 1
        while len(live):
            other = low[live] + k
            better = order[other] < order[best[live]]
            best[live[better]] = other[better]
            k += 1
            live = live[low[live] + k <= high[live]]
        # a window without a symbol of its own is its own anchor
        anchor = np.where(none, -1 - at, best)
        prefix = words.prefix_hashes(level0)
        head, many = repeats.records(anchor, at, owner[at])
        a, s0 = anchor[head], at[head]
        s1 = s0 + many - 1
        lone = a < 0
        l, r = np.where(lone, s0, left[np.maximum(a, 0)]), np.where(lone, s0 + width, right[np.maximum(a, 0)])
        context = words.range_hashes(prefix, l, r)
        name = np.where(lone, context, words.mix(context ^ symbols[np.maximum(a, 0)]))
        offset = l - s0
        span = words.mix(words.range_hashes(prefix, s0, s1 + width) + offset.astype(np.uint64) * _u(0x9FB21C651E98DF25) + many.astype(np.uint64))
        text = owner[s0]
        return {"name": name, "span": span, "text": text, "at": s0 - first[text], "n": many, "offset": offset}

    return run


def resolved(rows: DataFrame, found: DataFrame, width: int, buckets: int) -> DataFrame:
    """The single windows of open records that occur again, as id, key, found."""
    wanted = found.where("needs")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[repeats.Records] = []
            for start, parts in words.chunks(list(batch["text"])):
                buffer, starts, ends, first = words.word_bounds(parts)
                if not len(starts):
                    continue
                level0 = words.word_hashes(buffer, starts, ends)
                one, two = words.prefix_hashes(level0), words.prefix_hashes(words.mix(level0 + _u(0xE7037ED1A0B428DB)))
                for i in range(len(parts)):
                    row = batch.iloc[start + i]
                    rec = repeats.entries(row["found"])
                    rec = rec[(rec["state"] & (OPEN | PARTNER)) > 0]
                    n = rec["n"].astype(np.int64)
                    at = np.repeat(rec["at"].astype(np.int64) - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                    s = at + first[i]
                    out.append({
                        "hash": words.range_hashes(one, s, s + width), "check": words.range_hashes(two, s, s + width),
                        "id": np.full(len(s), row["id"]), "key": np.full(len(s), row["key"]), "at": at,
                        "asks": np.repeat((rec["state"] & OPEN) > 0, n).astype(np.uint8),
                    })
            if out:
                yield from repeats.dealt_windows({k: np.concatenate([o[k] for o in out]) for k in out[0]}, buckets)

    asked = repeats.with_found(rows, wanted.select("id", "key", "found"), "inner")
    return repeats.meeting_windows(asked.mapInPandas(scan, repeats.schema_of(repeats.WINDOW_FIELDS)), buckets)


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 35) -> DataFrame:
    """id, n_words, n_removed, kept (the kept words joined by a space) of every row."""
    rows = repeats.rows_of(docs, doc_id, text)
    found = repeated_windows(rows, width)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total, gone, kept = [], [], []
            for t, f in zip(batch["text"], batch["found"], strict=True):
                w = [x for x in t.encode("utf-8", "surrogatepass").split()]
                lost = repeats.covered(repeats.entries(f), width, len(w))
                total.append(len(w))
                gone.append(int(lost.sum()))
                kept.append(b" ".join(x for x, o in zip(w, lost.tolist(), strict=True) if not o).decode("utf-8", "surrogatepass"))
            ids = pd.array(batch["id"].to_numpy(np.int64), dtype="Int64")
            ids[batch["id"].to_numpy(np.int64) == NO_ID] = pd.NA
            yield pd.DataFrame({doc_id: ids, "n_words": total, "n_removed": gone, "kept": kept})

    joined = repeats.with_found(rows, found, "left").select("id", "text", "found")
    return joined.mapInPandas(cut, f"`{doc_id}` bigint, n_words bigint, n_removed bigint, kept string")


def repeated_windows(rows: DataFrame, width: int) -> DataFrame:
    """id, key, found: the repeated windows of each document that has some."""
    buckets = repeats.buckets_for(rows)
    known = repeats.census(rows, anchoring(width), buckets).checkpoint()
    more = resolved(rows, known, width, buckets)
    return known.where("repeats").select("id", "key", "found").union(more.select("id", "key", "found"))


def digest(kept: str | bytes) -> str:
    data = kept.encode("utf-8", "surrogatepass") if isinstance(kept, str) else kept
    return hashlib.sha256(data).hexdigest()
