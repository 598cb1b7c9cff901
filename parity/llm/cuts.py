"""Texts cut where neither a byte-level BPE nor a sentencepiece BPE can join characters, by Arrow's own kernels.

A cut lies before a space that stands alone between two other characters, and before such a line end. The pre-tokenizer
of a byte-level BPE always begins a piece there, and no piece of a sentencepiece BPE holds a space mark or a line end
after another character. So both encode the units between cuts independently, and equal units are looked at once.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space in the sense of either library, and more: wherever two meet, or one that is not a space or a line end
#: stands (or a mark of this module), the text is cut by the slower rule.
_ODD = r"[\s\v\x1c-\x1f\x{85}\p{Z}]"
_UNEVEN = rf"{_ODD}{_ODD}|[\x01\x02\t\r\f\v\x1c-\x1f\x{{85}}\x{{a0}}]|[^\P{{Z}} ]|^{_ODD}|{_ODD}$"
_CUT = re.compile(r"(?<=\S) (?=\S)|(?<=\S)(?=\n\S)")


#: First characters of pieces: the first piece of a text, and a piece that is exactly the text after the mark.
FIRST, EXACT = "\1", "\2"


def pieces(texts: pa.Array, whole: np.ndarray | None = None) -> tuple[list[str], int, pa.Array, np.ndarray]:
    """(distinct pieces, how many of them come from even texts, index of the piece at each place, first place of each
    text and the end). A piece without a mark stands for a space and itself, one that begins with a line end for itself.
    Null and empty texts have no pieces; texts marked in ``whole`` are a piece of their own."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    uneven = pc.or_(pc.match_substring_regex(texts, _UNEVEN), pc.equal(texts, "")).to_numpy(zero_copy_only=False)
    if whole is not None:
        uneven = uneven | whole
    even = np.flatnonzero(~uneven)
    taken = texts if len(even) == len(texts) else texts.take(pa.array(even))
    taken = pc.binary_join_element_wise(pa.scalar(FIRST, pa.large_string()), taken, pa.scalar("", pa.large_string()))
    parts = pc.split_pattern(pc.replace_substring(taken, "\n", " \n"), " ")
    edges = parts.offsets.to_numpy().astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    names, at = coded.dictionary.to_pylist(), coded.indices
    odd = np.flatnonzero(uneven)
    if len(odd) == 0:
        return names, len(names), at, edges
    at = at.to_numpy(zero_copy_only=False)
    lengths = np.zeros(len(texts), np.int64)
    lengths[even] = np.diff(edges)
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
    for k, i in enumerate(even):
        out[i] = at[edges[k] : edges[k + 1]]
    index: dict[str, int] = {}
    for i in odd.tolist():
        text = texts[i].as_py()
        found = [text] if text and whole is not None and whole[i] else _CUT.split(text) if text else []
        # what was cut off before a space lost it
        found = [f"{FIRST if k == 0 else EXACT}{w if k == 0 or w[0] == chr(10) else ' ' + w}" for k, w in enumerate(found)]
        out[i] = np.fromiter((index.setdefault(w, len(names) + len(index)) for w in found), np.int32, len(found))
        lengths[i] = len(found)
    return names + list(index), len(names), pa.array(np.concatenate(out)), np.concatenate([[0], np.cumsum(lengths)])


def text_of(piece: str, lead: str = "") -> str:
    """The text a piece stands for; ``lead`` comes before the first piece of a text."""
    mark = piece[0]
    if mark == FIRST:
        return f"{lead}{piece[1:]}"
    if mark == EXACT:
        return piece[1:]
    return piece if mark == "\n" else f" {piece}"


def units(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(units, index of the unit at each place, first place of each text and the end); the units of a text put together
    are a space and the text. A unit can be listed twice: as the first of a text and as a later one."""
    found, _, at, edges = pieces(texts)
    return [text_of(p, " ") for p in found], at.to_numpy(zero_copy_only=False).astype(np.int64), edges
