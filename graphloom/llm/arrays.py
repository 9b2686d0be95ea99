"""NumPy kernels over Arrow text columns: words, hashes, shingles, minimizers.

All kernels work on a flat UTF-8 byte array with document offsets, so the cost
per byte is a few vector instructions and no Python object is made per word.
Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_ODD = U64(0x9E3779B97F4A7C15 | 1)
_INVERSE = U64(pow(int(_ODD), -1, 1 << 64))
_powers = [np.ones(1, U64), np.ones(1, U64)]

#: Bytes of text handled at once; a longer single document is its own chunk.
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor, shift, multiply); a bijection."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(29))
    x = x * U64(0xA0761D6478BD642F)
    return x ^ (x >> U64(32))


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    return mix(x + U64((salt * 0xBF58476D1CE4E5B9 + 0x1B873593) % (1 << 64)))


BYTE = salted(np.arange(1, 257, dtype=U64), 11)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64 and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_ODD, _INVERSE)):
            x = np.full(size, base, U64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=U64)
    return _powers[0][:n], _powers[1][:n]


class Prefix:
    """Prefix polynomial hashes of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the slices [start, end); equal slices have equal hashes."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64))


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of an Arrow string or binary column; null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, pa.scalar(b"", pa.large_binary()))
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(data: np.ndarray, off: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, end, bytes, offsets) with about `most` bytes each."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        j = min(j, n, i + 20_000)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(data: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the first word of each document (n + 1)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    ink = ~space[data]
    after = np.empty(n, bool)
    after[0], after[1:] = True, ~ink[:-1]
    cuts = off[:-1][off[:-1] < n]
    after[cuts] = True
    start = np.flatnonzero(ink & after)
    last = np.empty(n, bool)
    last[-1], last[:-1] = True, ~ink[1:]
    last[cuts[cuts > 0] - 1] = True
    end = np.flatnonzero(ink & last) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    return Prefix(table[data]).of(start, end)


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words and the first of each document.

    A document with fewer words gives its whole sequence once; one without words none.
    """
    count = np.diff(first)
    n = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    begin = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(count)), n)
    at = first[doc] + np.arange(begin[-1]) - begin[doc]
    end = np.minimum(at + size, first[doc + 1])
    return Prefix(mix(hashes)).of(at, end), begin


def minimizers(hashes: np.ndarray, n_windows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Content-chosen anchors.

    `hashes` has, for each document, n_windows + width - 1 grams (none if it has no
    window), one after the other.  The anchor of a window of `width` grams is its
    leftmost gram of least hash, so equal windows have equal anchors at equal offsets.
    Returns, by run of windows with one anchor: gram index of the anchor, first and
    last window's gram index.
    """
    none = np.zeros(0, np.int64)
    if not len(hashes):
        return none, none, none
    bits = max(20, int(len(hashes) - 1).bit_length())
    key = (hashes >> U64(bits) << U64(bits)) | np.arange(len(hashes), dtype=U64)
    pad = -len(key) % width
    blocks = np.concatenate([key, np.full(pad, ~U64(0), U64)]).reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    grams = np.where(n_windows > 0, n_windows + width - 1, 0)
    begin = np.concatenate([[0], np.cumsum(grams)])[:-1]
    total = int(n_windows.sum())
    doc = np.repeat(np.arange(len(n_windows)), n_windows)
    at = np.arange(total) + (begin - np.concatenate([[0], np.cumsum(n_windows)])[:-1])[doc]
    anchor = (np.minimum(right[at], left[at + width - 1]) & U64((1 << bits) - 1)).astype(np.int64)
    turn = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if total else none
    last = np.concatenate([turn[1:], [total]]) - 1 if total else none
    return anchor[turn], at[turn], at[last]


def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the range and the value for each integer in the ranges [first, last)."""
    n = last - first
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - (np.cumsum(n) - n)[owner] + first[owner]


def covered(start: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """Which of `size` places lie in any of the ranges [start, end)."""
    delta = np.bincount(start, minlength=size + 1)[: size + 1] - np.bincount(end, minlength=size + 1)[: size + 1]
    return np.cumsum(delta)[:size] > 0
