"""Text columns as byte arrays: words, hashes of words and hashes of windows, all texts of a batch at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is a piece of its own.
PIECE_BYTES = 1 << 18

#: Base of the hash polynomial and the two odd factors of the final mix (splitmix64).
BASE = 0x9E3779B97F4A7C15
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table that is true for the bytes of the ranges, ends included."""
    table = np.zeros(256, dtype=bool)
    for first, last in ranges:
        table[first : last + 1] = True
    return table


#: White space as the contracts write it: \x20 and \x09 to \x0D.
NOT_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))


def pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``first row, last row + 1, bytes, bounds`` for runs of texts of some length together.

    ``bounds`` has a place more than there are rows. Null texts are empty ones.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    filled = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets, data = filled.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[filled.offset : filled.offset + len(filled) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(filled):
        last = int(np.searchsorted(at, at[first] + PIECE_BYTES, side="right")) - 1
        last = min(max(last, first + 1), len(filled))
        yield first, last, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``starts, ends, rows`` of the maximal runs of true bytes that stay within a text."""
    n = len(inside)
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    before[bounds[:-1][bounds[:-1] < n]] = False
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(bounds, starts, side="right") - 1


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX[0])
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX[1])
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as were needed so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, PIECE_BYTES + 1)
            self.up, self.down = (powers(base, n) for base in (BASE, pow(BASE, -1, 1 << 64)))

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Running sums of the polynomial's terms; the hash of a span is a difference of two."""
        self.reach(len(data) + 1)
        terms = (data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)]
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(terms, out=total[1:])
        return total

    def spans(self, total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of the spans; spans of equal bytes have equal hashes."""
        h = (total[ends] - total[starts]) * self.down[starts]
        return mixed(h + (ends - starts).astype(np.uint64))


def windows(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every ``n`` consecutive words, in order; across texts too, which callers leave out."""
    m = len(word_hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(m, dtype=np.uint64)
    for i in range(n):
        h = h * np.uint64(BASE) + word_hashes[i : i + m]
    return mixed(h)
