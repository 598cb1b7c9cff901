"""Words and their hashes, many texts at a time, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_MASK = 0xFFFFFFFFFFFFFFFF
#: Odd, so that it has an inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text handled at a time (a longer text is handled alone).
CHUNK = 1 << 19

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    done, step = 1, base
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(step)
        done += more
        step = step * step & _MASK
    return out


class _Powers:
    up = powers(_BASE, 1 << 16)
    down = powers(_INVERSE, 1 << 16)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            cls.up, cls.down = powers(_BASE, size), powers(_INVERSE, size)
        return cls.up[:n], cls.down[:n]


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """p with p[j] - p[i] the polynomial of values[i:j] times base^i."""
    up, _ = _Powers.upto(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up, out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each range that depends on its values alone."""
    _, down = _Powers.upto(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def byte_values(buffer: np.ndarray) -> np.ndarray:
    return _BYTE[buffer]


def chunks(texts: list[str | None], limit: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first text, encoded texts) with a bounded number of bytes together."""
    first, part, size = 0, [], 0
    for i, text in enumerate(texts):
        part.append(text.encode("utf-8", "surrogatepass") if text else b"")
        size += len(part[-1]) + 1
        if size >= limit:
            yield first, part
            first, part, size = i + 1, [], 0
    if part:
        yield first, part


def word_bounds(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, start and end of each word in it, number of words before each text and in all)."""
    joined = b"\n".join(parts) + b"\n"
    buffer = np.frombuffer(joined, np.uint8)
    inside = np.zeros(len(buffer) + 1, np.int8)
    inside[1:] = ~_BLANK[buffer]
    steps = np.diff(inside)
    starts, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    offsets = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
    return buffer, starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hashes(prefix_hashes(byte_values(buffer)), starts, ends)


def shingle_sets(parts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct hashes of ``size`` consecutive words of each text; of all its words where it has fewer."""
    buffer, starts, ends, first = word_bounds(parts)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * len(parts)
    prefix = prefix_hashes(word_hashes(buffer, starts, ends))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            at = np.arange(a, b - size + 1)
            out.append(np.unique(range_hashes(prefix, at, at + size)))
        elif b > a:
            out.append(range_hashes(prefix, np.array([a]), np.array([b])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
