"""Words and word shingles of Arrow text columns as numpy hashes.

A word is a run of bytes outside `[\\x20\\x09-\\x0D]`, with A-Z lower-cased. Everything is computed over whole
texts in slices of about a quarter of a megabyte, so memory does not follow the batch size. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finalizer of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _letters() -> np.ndarray:
    """One fixed random number per byte; capital and small letters share theirs."""
    table = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
    table[65:91] = table[97:123]
    return table


_LETTER = _letters()


class _Powers:
    """Powers of the base and of its inverse, kept for as long a slice as was seen."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > SLICE_BYTES * 2:  # one very long text: not worth keeping
            return cls._made(n)
        if n > len(cls.up):
            cls.up, cls.down = cls._made(max(n, SLICE_BYTES))
        return cls.up[:n], cls.down[:n]

    @staticmethod
    def _made(n: int) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for base in (_BASE, _INVERSE):
            powers = np.full(n, base, np.uint64)
            powers[0] = 1
            out.append(np.multiply.accumulate(powers))
        return out[0], out[1]


@dataclass
class Words:
    """Words of the texts `low` to `high` of a column.

    hashes: one number per word; first: where each text's words begin, and the end; begin, end: byte offsets in `data`;
    data: the texts' bytes, one after the other; text: where each text's bytes begin, and the end.
    """

    low: int
    high: int
    hashes: np.ndarray
    first: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    data: np.ndarray
    text: np.ndarray
    sums: np.ndarray
    down: np.ndarray

    def prefixes(self, size: int) -> np.ndarray:
        """A number for the first `size` bytes of each word, or for the whole of a shorter one."""
        return mix((self.sums[np.minimum(self.begin + size, self.end)] - self.sums[self.begin]) * self.down[self.begin])


def iter_words(column: pa.Array | pa.ChunkedArray) -> Iterator[Words]:
    """The column's texts, slice by slice."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + SLICE_BYTES, "right")) - 1)
        high = min(high, n)
        yield _words(low, high, raw[at[low] : at[high]], at[low : high + 1] - at[low])
        low = high


def _words(low: int, high: int, data: np.ndarray, text: np.ndarray) -> Words:
    n = len(data)
    inside = ~_SPACE[data]
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    before[text] = False
    begin = np.flatnonzero(inside & ~before[:n])
    after = np.zeros(n + 1, bool)
    after[:n] = inside
    after[text] = False
    end = np.flatnonzero(inside & ~after[1:]) + 1
    if n:
        up, down = _Powers.of(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTER[data] * up, out=sums[1:])
        hashes = mix((sums[end] - sums[begin]) * down[begin])
    else:
        hashes, sums, down = np.zeros(0, np.uint64), np.zeros(1, np.uint64), np.zeros(0, np.uint64)
    return Words(low, high, hashes, np.searchsorted(begin, text), begin, end, data, text, sums, down)


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words, in order, and where each text's runs begin (and the end).

    A text of fewer words (but at least one) has one run: all its words.
    """
    h, first = words.hashes, words.first
    sizes = np.diff(first)
    counts = np.where(sizes >= width, sizes - width + 1, (sizes > 0).astype(sizes.dtype))
    starts = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=starts[1:])
    total = int(starts[-1])
    if not total:
        return np.zeros(0, np.uint64), starts
    at = np.arange(total) - np.repeat(starts[:-1], counts) + np.repeat(first[:-1], counts)
    out = np.zeros(total, np.uint64)
    last = np.repeat(first[1:], counts)
    for j in range(width):
        here = at + j
        ok = here < last
        term = h[np.minimum(here, len(h) - 1)] * np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64))
        out += np.where(ok, term, np.uint64(j + 1))
    return mix(out), starts


def distinct_per_text(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values in rising order, and where each text's begin (and the end)."""
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    counts = np.bincount(owner[keep], minlength=len(starts) - 1)
    out = np.zeros(len(starts), np.int64)
    np.cumsum(counts, out=out[1:])
    return values[keep], out
