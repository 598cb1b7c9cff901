"""Encoding with a byte-level BPE of the tokenizers library, each distinct piece of text once.

Texts are cut where the pre-tokenizer always begins a new piece (``cuts.pieces``): Arrow's kernels cut a batch and
number its distinct pieces, so Python sees each of them once a batch, and the library only those that a worker does not
remember.
Texts that hold a special token are given to the library whole. Either way the ids are those of the whole text.
"""

from __future__ import annotations

import os
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from parity.llm import cuts

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: Bytes of remembered pieces, by an estimate from above, before a worker forgets the rare ones.
KEPT_BYTES = 128 << 20
#: What an entry takes beside its text and ids.
ENTRY_BYTES = 220
#: Pieces encoded in one call.
TOGETHER = 1 << 14


class PieceEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        tokens = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(tokens.values()) + 1, bool)
        self.spaced[[i for t, i in tokens.items() if t[0] in "ĠĊ"]] = True
        #: Bytes of remembered pieces; KEPT_BYTES if not set.
        self.kept_bytes: int | None = None
        self._forget()

    def _most(self) -> int:
        return KEPT_BYTES if self.kept_bytes is None else self.kept_bytes

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.lengths = np.zeros(1 << 14, np.int64)
        #: In how many batches each entry was met.
        self.met = np.zeros(1 << 14, np.int32)
        self.used = self.entries = self.bytes = 0

    def _forget_rare(self) -> None:
        """Keep the pieces that come again and again, at most half of what may be kept."""
        names, met = list(self.index), self.met[: self.entries]
        entry = np.fromiter(self.index.values(), np.int64, len(names))
        order = np.argsort(-met[entry], kind="stable")
        sizes = ENTRY_BYTES + np.array([2 * len(names[k]) for k in order.tolist()]) + 4 * self.lengths[entry[order]]
        order = order[(met[entry[order]] > 1) & (np.cumsum(sizes) < self._most() // 2)]
        kept = entry[order]
        flat, lengths, seen = self._gathered(kept), self.lengths[kept], met[kept] // 2
        self._forget()
        self._keep([names[k] for k in order.tolist()], flat, lengths)
        self.met[: len(seen)] = seen

    def _keep(self, units: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        first, n = self.entries, len(units)
        while len(self.ids) < self.used + len(flat):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.starts) < first + n:
            self.starts, self.lengths, self.met = (
                np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths, self.met)
            )
        self.ids[self.used : self.used + len(flat)] = flat
        self.lengths[first : first + n] = lengths
        self.starts[first : first + n] = self.used + np.cumsum(lengths) - lengths
        self.index.update(zip(units, range(first, first + n), strict=True))
        self.used += len(flat)
        self.entries += n
        self.bytes += ENTRY_BYTES * n + 2 * sum(map(len, units)) + 4 * len(flat)

    def _gathered(self, entries: np.ndarray) -> np.ndarray:
        """The ids of the entries, one after another."""
        lengths = self.lengths[entries]
        ends = np.cumsum(lengths)
        return self.ids[np.repeat(self.starts[entries] - (ends - lengths), lengths) + np.arange(int(lengths.sum()))]

    def _learn(self, words: list[str], rest: list[str]) -> None:
        """Words are encoded in one call: an id whose token begins with the space or the line end begins a piece."""
        for k in range(0, len(words), TOGETHER):
            some = words[k : k + TOGETHER]
            # a word alone follows a space, one with a line end follows nothing
            text = f" {' '.join(some)}".replace(" \n", "\n")
            encoding = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
            ids = np.array(encoding.ids, np.uint32)
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) != len(some):
                raise ValueError("this tokenizer joins text across a space")
            self._keep(some, ids, np.diff(np.append(starts, len(ids))))
        for k in range(0, len(rest), TOGETHER):
            some = rest[k : k + TOGETHER]
            texts = [cuts.text_of(p) for p in some]
            found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            self._keep(some, np.concatenate(found), np.array([len(f) for f in found], np.int64))

    def encode(self, texts: pa.Array | list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text); ``end`` is put after each text."""
        if self.bytes > self._most():
            self._forget_rare()
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        whole = np.zeros(len(texts), bool)
        for mark in self.special:
            whole |= pc.fill_null(pc.match_substring(texts, mark), False).to_numpy(zero_copy_only=False)
        names, n_even, at, edges = cuts.pieces(texts, whole)
        entry = np.fromiter(map(self.index.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(entry < 0)
        if len(new):
            words, rest = [], []
            for k in new.tolist():
                (words if k < n_even and names[k][0] != cuts.FIRST else rest).append(names[k])
            first = self.entries
            self._learn(words, rest)
            is_word = np.array([k < n_even and names[k][0] != cuts.FIRST for k in new.tolist()])
            entry[new[is_word]] = first + np.arange(len(words))
            entry[new[~is_word]] = first + len(words) + np.arange(len(rest))
        self.met[entry] += 1
        # the ids of each distinct piece, and of the end, as a list; Arrow copies the list of every place
        lists, sizes = self._gathered(entry), self.lengths[entry]
        if end is not None:
            lists, sizes = np.append(lists, np.uint32(end)), np.append(sizes, 1)
            at = pa.array(np.insert(at.to_numpy(zero_copy_only=False), edges[1:], len(names)))
            edges = edges + np.arange(len(edges))
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        taken = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(lists.astype(np.uint32))).take(at)
        upto = taken.offsets.to_numpy()
        return taken.values.to_numpy()[upto[0] : upto[-1]], np.diff(upto[edges])


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str, kept_bytes: int | None = None) -> PieceEncoder:
    """One for each worker process and tokenizer; it goes on with the bound of the last caller."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    _ENCODERS[path].kept_bytes = kept_bytes
    return _ENCODERS[path]
