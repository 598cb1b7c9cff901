"""Alignment of two tokenizers over the same bytes: a byte-level BPE (A) and a sentencepiece BPE (B).

Both encode a space and the text. The character offsets of A's tokens and the spans of B's pieces are the coarse cuts;
where several tokens share a character (part of a multibyte character, or byte fallback) the decoded bytes of the
tokens place the cuts inside it. The places at which tokens of both end part the bytes into groups, and tokens whose
bytes overlap are linked.

Texts are cut into units that both tokenizers encode independently (``cuts.units``), so no group and no link crosses a
unit. A worker aligns each new unit once and keeps what it found in a table bounded by bytes.

On Spark: one pass without a shuffle writes the figures of every document together with its distinct id pairs and
their numbers, packed. Tasks add up their pairs before the one aggregation by pair. The most frequent pairs
(``frequent`` of them, a bounded table that every worker reads once) are looked up in place; pairs beyond that are rare,
have no hot key and are joined by a shuffle.

Defined results: a null or empty text, or one whose joined bytes of either tokenizer differ from a space and the text
(such as one that holds U+2581), has no tokens: zeros, and '' for the groups. Repeated rows and null ids stay rows of
their own. Ties for the highest count all count as best. An empty table gives no rows. Other columns are left out. A
text must fit in a worker's memory.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parity.llm import cuts
from parity.llm.files import read_parquet, scratch_uri

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: A unit of one word.
_WORD = re.compile(r"[ \n]\S+")
#: Bytes of text aligned at a time, and bytes of found units a worker keeps.
CHUNK, KEPT_BYTES = 1 << 21, 144 << 20
#: Bits of a pair code that hold B's id.
B_BITS = 24
#: Pairs that a task adds up before it hands them on.
PAIRS = 1 << 21
#: Pairs looked up in place: 9 bytes each in every worker.
FREQUENT = 1_000_000


class Aligner:
    """Units and what the two tokenizers make of them."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        spelled = byte_letters()
        self.a_bytes: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = b"".join(spelled[c] if c in spelled else c.encode() for c in token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
            raise ValueError("this sentencepiece model joins text across a space or a line end")
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.fallback = np.array([self.b.is_byte(i) for i in range(len(pieces))])
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in xs]) for xs in (self.a_bytes, self.b_bytes))
        ids = range(max(len(self.a_bytes), len(self.b_bytes)))
        #: Every id followed by each mark of the groups.
        self.numbers = pa.array([f"{i}{mark}" for i in ids for mark in ",|;"], pa.large_string())
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.groups: list[bytes] = []  # of each entry
        self.pairs: list[bytes] = []  # its linked pair codes, with repeats
        self.figures = np.zeros((1 << 12, 5), np.int64)  # n_a, n_b, n_groups, n_links, valid
        self.met = np.zeros(1 << 12, np.int32)
        self.bytes = 0

    def _forget_rare(self) -> None:
        """Keep the units that were met in several batches, at most half of what may be kept."""
        names, met = list(self.index), self.met
        order = sorted((k for k in range(len(names)) if met[k] > 1), key=lambda k: -met[k])
        old = (self.groups, self.pairs, self.figures, met)
        self._forget()
        for k in order:
            if self.bytes > KEPT_BYTES // 2:
                break
            self._keep(names[k], old[0][k], old[1][k], old[2][k])
            self.met[self.index[names[k]]] = old[3][k] // 2

    def _keep(self, unit: str, groups: bytes, pairs: bytes, figures) -> None:
        k = self.index[unit] = len(self.groups)
        if k == len(self.figures):
            self.figures = np.concatenate([self.figures, np.zeros_like(self.figures)])
            self.met = np.concatenate([self.met, np.zeros_like(self.met)])
        self.groups.append(groups)
        self.pairs.append(pairs)
        self.figures[k], self.met[k] = figures, 0
        self.bytes += 300 + 2 * len(unit) + len(groups) + len(pairs)

    def _learn(self, new: list[str]) -> None:
        """Align new units: those of one word all together, the others one by one."""
        plain = [u for u in new if _WORD.fullmatch(u)]
        if not self._learn_together(plain):
            self._learn_each(plain)
        self._learn_each([u for u in new if not _WORD.fullmatch(u)])

    def _learn_each(self, new: list[str]) -> None:
        a_ids, a_ends, a_valid = self._tokens_a(new)
        b_ids, b_ends, b_valid = self._tokens_b(new)
        for k, unit in enumerate(new):
            if not (a_valid[k] and b_valid[k]):
                self._keep(unit, b"", b"", (0, 0, 0, 0, 0))
                continue
            found, pairs = grouped(a_ids[k], a_ends[k], b_ids[k], b_ends[k])
            self._keep(unit, found, pairs.tobytes(), (len(a_ids[k]), len(b_ids[k]), found.count(b";") + 1, len(pairs), 1))

    def _learn_together(self, new: list[str]) -> bool:
        """One text of all units, cut again at their borders. False if its bytes are not those of the tokens."""
        if not new:
            return True
        text = "".join(new)
        data = text.encode()
        places = None if len(data) == len(text) else char_places(data)
        e = self.a.encode_batch([text], add_special_tokens=False)[0]
        a = np.array(e.ids, np.int64)
        spans = np.array(e.offsets, np.int64)
        shared = np.append(spans[1:, 0] < spans[:-1, 1], False)
        a_ends = refined_all(spans[:, 1] if places is None else places[spans[:, 1]], shared, self.a_lengths[a])
        more = int(text[0] == " ")
        proto = self.b.encode([text[more:]], return_type="proto", num_threads=1)[0]
        pieces = proto.pieces if more else proto.pieces[1:]
        b = np.array([p.id for p in pieces], np.int64)
        b_ends = np.array([p.end for p in pieces], np.int64) + more
        b_ends = refined_all(b_ends, self.fallback[b], self.b_lengths[b])
        if b"".join([self.a_bytes[i] for i in e.ids]) != data or b"".join([self.b_bytes[i] for i in b.tolist()]) != data:
            return False
        cuts_at = np.intersect1d(a_ends, b_ends, assume_unique=True)
        lengths = [len(u) for u in new] if places is None else [len(u.encode()) for u in new]
        borders = np.cumsum(lengths)
        # tokens, groups and links up to each border
        n_a, n_b, n_groups = (np.searchsorted(x, borders, "right") for x in (a_ends, b_ends, cuts_at))
        a_starts, b_starts = a_ends - self.a_lengths[a], b_ends - self.b_lengths[b]
        first, last = np.searchsorted(b_ends, a_starts, "right"), np.searchsorted(b_starts, a_ends, "left")
        each = last - first
        upto = np.cumsum(each)
        partner = np.arange(int(upto[-1])) - np.repeat(upto - each - first, each)
        codes = np.repeat(a, each) << B_BITS | b[partner]
        n_links = upto[n_a - 1]
        # the ids in the order of the text of the groups, each with the mark that follows it
        a_group, b_group = np.searchsorted(cuts_at, a_ends), np.searchsorted(cuts_at, b_ends)
        a_upto = np.searchsorted(a_group, np.arange(len(cuts_at)), "right")
        b_upto = np.searchsorted(b_group, np.arange(len(cuts_at)), "right")
        order = np.zeros(len(a) + len(b), np.int64)
        b_before = np.concatenate([[0], b_upto[:-1]])
        a_mark, b_mark = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_mark[a_upto - 1], b_mark[b_upto - 1] = 1, 2
        order[np.arange(len(a)) + b_before[a_group]] = 3 * a + a_mark
        order[np.arange(len(b)) + a_upto[b_group]] = 3 * b + b_mark
        spelled = self.numbers.take(pa.array(order))
        ends = np.frombuffer(spelled.buffers()[1], np.int64, len(order) + 1)[n_a + n_b]
        written = spelled.buffers()[2].to_pybytes()[: int(ends[-1])]
        figures = np.diff(np.stack([n_a, n_b, n_groups, n_links], axis=1), axis=0, prepend=0)
        rows = np.concatenate([figures, np.ones((len(new), 1), np.int64)], axis=1)
        text_at, code_at = 0, 0
        raw = codes.tobytes()
        for unit, end, link, row in zip(new, ends.tolist(), n_links.tolist(), rows, strict=True):
            self._keep(unit, written[text_at : end - 1], raw[8 * code_at : 8 * link], row)
            text_at, code_at = end, link
        return True

    def _tokens_a(self, new: list[str]):
        """(ids, byte ends, whether the bytes are those of the unit) of each unit."""
        ids, ends, valid = [], [], []
        for unit, e in zip(new, self.a.encode_batch(new, add_special_tokens=False), strict=True):
            own = e.ids
            coarse = [y for _, y in e.offsets]
            if not unit.isascii():
                sizes = char_places(unit.encode()).tolist()
                starts = [x for x, _ in e.offsets]
                shared = [k + 1 < len(own) and starts[k + 1] < coarse[k] for k in range(len(own))]
                coarse = refined([sizes[y] for y in coarse], shared, [len(self.a_bytes[i]) for i in own])
            ids.append(own)
            ends.append(coarse)
            valid.append(b"".join([self.a_bytes[i] for i in own]) == unit.encode())
        return ids, ends, valid

    def _tokens_b(self, new: list[str]):
        ids, ends, valid = [], [], []
        # the model puts a space before a text; a unit of a line end begins with the piece of that space alone
        texts = [u[1:] if u[0] == " " else u for u in new]
        for unit, proto in zip(new, self.b.encode(texts, return_type="proto", num_threads=1), strict=True):
            more = int(unit[0] == " ")
            own = [(p.id, p.end + more) for p in proto.pieces][1 - more :]
            id_list, coarse = [i for i, _ in own], [y for _, y in own]
            if not unit.isascii() or any(self.fallback[i] for i in id_list):
                shared = [bool(self.fallback[i]) for i in id_list]
                coarse = refined(coarse, shared, [len(self.b_bytes[i]) for i in id_list])
            ids.append(id_list)
            ends.append(coarse)
            valid.append(b"".join([self.b_bytes[i] for i in id_list]) == unit.encode())
        return ids, ends, valid

    def entries(self, names: list[str]) -> np.ndarray:
        if self.bytes > KEPT_BYTES:
            self._forget_rare()
        # the first piece of a text and a later one can be the same unit
        new = list(dict.fromkeys(u for u in names if u not in self.index))
        for i in range(0, len(new), 1 << 14):
            self._learn(new[i : i + (1 << 14)])
        at = np.fromiter(map(self.index.__getitem__, names), np.int64, len(names))
        self.met[at] += 1
        return at


def byte_letters() -> dict[str, bytes]:
    """The letter by which byte-level vocabularies spell each byte: printable Latin-1 stands for itself, the other
    bytes in ascending order for the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): bytes([b]) for b in plain} | {chr(0x100 + k): bytes([b]) for k, b in enumerate(others)}


def char_places(data: bytes) -> np.ndarray:
    """Byte offset of each character offset of UTF-8 text."""
    starts = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    return np.append(starts, len(data))


def refined_all(coarse: np.ndarray, shared: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``refined`` for arrays: the last cut before a shared character, and the decoded bytes since."""
    if not shared.any():
        return coarse
    total = np.cumsum(lengths)
    at = np.maximum.accumulate(np.where(shared, -1, np.arange(len(coarse))))
    known = at >= 0
    return np.where(known, coarse[at] + total - total[at], total)


def refined(coarse: list[int], shared: list[bool], lengths: list[int]) -> list[int]:
    """Byte ends: the coarse cut, and inside a shared character the decoded bytes since the last cut."""
    out, last = [], 0
    for end, inside, n in zip(coarse, shared, lengths, strict=True):
        last = last + n if inside else end
        out.append(last)
    return out


def grouped(a_ids: list[int], a_ends: list[int], b_ids: list[int], b_ends: list[int]) -> tuple[bytes, np.ndarray]:
    """(groups as text, codes of all linked occurrence pairs) by one walk over both."""
    groups, pairs = [], []
    i = j = a_first = b_first = 0
    while i < len(a_ids) and j < len(b_ids):
        pairs.append(a_ids[i] << B_BITS | b_ids[j])
        x, y = a_ends[i], b_ends[j]
        i, j = i + (x <= y), j + (y <= x)
        if x == y:
            groups.append(f"{','.join(map(str, a_ids[a_first:i]))}|{','.join(map(str, b_ids[b_first:j]))}")
            a_first, b_first = i, j
    return ";".join(groups).encode(), np.array(pairs, np.int64)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each worker process."""
    key = (a_path, b_path)
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(a_path, b_path)
    return _ALIGNERS[key]


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about CHUNK bytes of text each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(sizes) // CHUNK
    first = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1, [len(sizes)]]) if len(sizes) else np.zeros(0, int)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        yield batch.slice(a, b - a)


def aligned_texts(model: Aligner, texts: pa.Array) -> dict[str, list | np.ndarray]:
    """Figures, digest and pairs of each text."""
    names, at, edges = cuts.units(texts)
    entry = model.entries(names)
    rows = len(texts)
    figures = model.figures[entry]
    sums = np.zeros((rows, 4), np.int64)
    bad = np.zeros(rows, bool)
    filled = np.flatnonzero(np.diff(edges))
    if len(filled):
        sums[filled] = np.add.reduceat(figures[at, :4], edges[filled], axis=0)
        bad[filled] = np.minimum.reduceat(figures[at, 4], edges[filled]) == 0
    sums[bad] = 0
    groups = [model.groups[k] for k in entry.tolist()]
    codes = [np.frombuffer(model.pairs[k], np.int64) for k in entry.tolist()]
    n_codes = np.array([len(c) for c in codes], np.int64)
    flat = np.concatenate(codes) if codes else np.zeros(0, np.int64)
    first = np.cumsum(n_codes) - n_codes
    digests, pairs, counts = [], [], []
    for k in range(rows):
        own = at[edges[k] : edges[k + 1]]
        if bad[k] or not len(own):
            digests.append("")
            pairs.append(b"")
            counts.append(b"")
            continue
        digest = hashlib.sha256()
        for i in range(0, len(own), 1 << 16):
            digest.update((b";" if i else b"") + b";".join([groups[u] for u in own[i : i + (1 << 16)].tolist()]))
        digests.append(digest.hexdigest())
        # each distinct unit once, with its number
        u, n = np.unique(own, return_counts=True)
        m = n_codes[u]
        ends = np.cumsum(m)
        c = flat[np.repeat(first[u] - (ends - m), m) + np.arange(int(m.sum()))]
        order = np.argsort(c, kind="stable")
        c, n = c[order], np.repeat(n, m)[order]
        starts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        pairs.append(c[starts].tobytes())
        counts.append(np.add.reduceat(n, starts).astype(np.int64).tobytes())
    return {"sums": sums, "digests": digests, "pairs": pairs, "counts": counts}


FIGURES = ("n_a", "n_b", "n_groups", "n_links")


def _packed(docs: DataFrame, a_path: str, b_path: str, doc_id: str, text: str) -> DataFrame:
    """One row a document: a key of the row, the id, the figures, and its pairs."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = aligner(a_path, b_path)
        key = TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in slices(whole, "text"):
                out = aligned_texts(model, batch.column("text"))
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(key, key + n)), batch.column("id"),
                     *(pa.array(out["sums"][:, c]) for c in range(4)),
                     pa.array(out["digests"], pa.string()),
                     pa.array(out["pairs"], pa.binary()), pa.array(out["counts"], pa.binary())],
                    names=["row_key", "id", *FIGURES, "groups_sha256", "pairs", "counts"],
                )
                key += n

    figures = ", ".join(f"{f} bigint" for f in FIGURES)
    return rows.mapInArrow(
        run, f"row_key bigint, id {kind}, {figures}, groups_sha256 string, pairs binary, counts binary"
    )


def _flat(column: pa.Array) -> np.ndarray:
    """All 64-bit numbers of a binary column, one after another."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int64)


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    c, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(c, kind="stable")
    c, n = c[order], n[order]
    starts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    return c[starts], np.add.reduceat(n, starts)


def pair_counts(packed: DataFrame) -> DataFrame:
    """``code``, ``links`` and whether that is the ``best`` of its B id, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, waiting = [], [], 0

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(codes[0]), pa.array(counts[0])], names=["code", "links"])

        for batch in batches:
            codes.append(_flat(batch.column("pairs")))
            counts.append(_flat(batch.column("counts")))
            waiting += len(codes[-1])
            if waiting > 2 * PAIRS:
                c, n = _summed(codes, counts)
                codes, counts, waiting = [c], [n], len(c)
                if waiting > PAIRS:
                    yield table()
                    codes, counts, waiting = [], [], 0
        if waiting:
            c, n = _summed(codes, counts)
            codes, counts = [c], [n]
            yield table()

    parts = packed.where("n_links > 0").select("pairs", "counts").mapInArrow(run, "code bigint, links bigint")
    sums = parts.groupBy("code").agg(F.sum("links").alias("links"))
    b_id = F.col("code").bitwiseAND((1 << B_BITS) - 1)
    sums = sums.withColumn("b_id", b_id)
    most = sums.groupBy("b_id").agg(F.max("links").alias("most"))
    return sums.join(most, "b_id").select("code", "links", (F.col("links") == F.col("most")).alias("best"))


_TABLES: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _table(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The frequent pairs by code, read once by a worker."""
    if uri not in _TABLES:
        _TABLES.clear()
        t = read_parquet(uri)
        code = t["code"].to_numpy()
        order = np.argsort(code)
        _TABLES[uri] = (code[order], t["links"].to_numpy()[order], t["best"].to_numpy()[order])
    return _TABLES[uri]


def _scored(packed: DataFrame, uri: str) -> DataFrame:
    """Each document with the sums over its frequent pairs, and the pairs that are not among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, links, best = _table(uri)
        for batch in batches:
            sizes = pc.binary_length(batch.column("pairs")).to_numpy(zero_copy_only=False) // 8
            flat, n = _flat(batch.column("pairs")), _flat(batch.column("counts"))
            edges = np.concatenate([[0], np.cumsum(sizes)])
            at = np.minimum(np.searchsorted(code, flat), max(len(code) - 1, 0))
            known = code[at] == flat if len(code) else np.zeros(len(flat), bool)
            total, n_best = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            filled = np.flatnonzero(sizes)
            if len(filled):
                each = np.where(known, n, 0)
                total[filled] = np.add.reduceat(each * links[at] if len(code) else each, edges[filled])
                n_best[filled] = np.add.reduceat(each * best[at] if len(code) else each, edges[filled])
            rest = np.flatnonzero(~known)
            offsets = np.searchsorted(rest, edges).astype(np.int32)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[rest])) for x in (flat, n)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row_key", "id", *FIGURES, "groups_sha256")),
                 pa.array(n_best), pa.array(total), *lists],
                names=["row_key", "id", *FIGURES, "groups_sha256", "n_best", "count_sum", "rest", "rest_n"],
            )

    figures = ", ".join(f"{f} bigint" for f in FIGURES)
    kind = packed.schema["id"].dataType.simpleString()
    return packed.mapInArrow(
        run,
        f"row_key bigint, id {kind}, {figures}, groups_sha256 string, n_best bigint, count_sum bigint, "
        "rest array<bigint>, rest_n array<bigint>",
    )


def aligned(
    docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text", frequent: int = FREQUENT
) -> tuple[DataFrame, DataFrame]:
    """(one row a document, one row an id pair).

    Documents: the id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. Pairs: a_id, b_id, links, best.
    The paths are those of the vocabularies on every executor."""
    spark = docs.sparkSession
    folder = scratch_uri(spark, "alignment")
    _packed(docs, a_path, b_path, doc_id, text).write.parquet(f"{folder}/documents")
    packed = spark.read.parquet(f"{folder}/documents")
    pair_counts(packed).write.parquet(f"{folder}/pairs")
    pairs = spark.read.parquet(f"{folder}/pairs")
    common = pairs.orderBy(F.col("links").desc(), "code").limit(frequent)
    common.coalesce(1).write.parquet(f"{folder}/frequent")
    found = _scored(packed, f"{folder}/frequent")
    if pairs.count() > frequent:
        found.write.parquet(f"{folder}/scored")
        found = spark.read.parquet(f"{folder}/scored")
        rare = found.where("size(rest) > 0").select(
            "row_key", F.explode(F.arrays_zip("rest", "rest_n")).alias("p")
        ).select("row_key", F.col("p.rest").alias("code"), F.col("p.rest_n").alias("n"))
        more = rare.join(pairs, "code").groupBy("row_key").agg(
            F.sum(F.col("n") * F.col("best").cast("bigint")).alias("more_best"),
            F.sum(F.col("n") * F.col("links")).alias("more_sum"),
        )
        found = found.join(more, "row_key", "left").withColumns({
            "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)),
            "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0)),
        })
    documents = found.select(
        F.col("id").alias(doc_id), *FIGURES, "n_best", "count_sum", "groups_sha256"
    )
    b_id = F.col("code").bitwiseAND((1 << B_BITS) - 1)
    return documents, pairs.select(F.shiftright("code", B_BITS).alias("a_id"), b_id.alias("b_id"), "links", "best")
