"""Words of a whole Arrow text column at once, as numpy arrays over its UTF-8 bytes.

The operators that look at every word of every document (token shards, packing, substring dedup) work on
slices of a batch: one byte array, the place of each word in it and a 64-bit hash of each word. No Python
object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer single text is a slice of its own.
SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; kept for texts of the usual length."""
    key = int(base)
    if len(_powers.get(key, ())) < n:
        size = max(n, SLICE_BYTES + 1)
        made = np.full(size, base, np.uint64)
        made[0] = 1
        np.multiply.accumulate(made, out=made)
        if size > 4 * SLICE_BYTES:
            return made[:n]
        _powers[key] = made
    return _powers[key][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of runs of rows with about SLICE_BYTES of text. Null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; none goes over the end of a row."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    heads = np.zeros(n + 1, bool)
    heads[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | heads[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | heads[1:])) + 1
    return starts, ends


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are no ASCII white space."""
    return runs(~_SPACE[data], offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span: differences of one prefix sum of weighted bytes, brought to the same power."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=sums[1:])
    back = _power(_INVERSE, len(data) + 1)
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def rows_of(offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The row of each span, by where it starts."""
    return np.searchsorted(offsets, starts, "right") - 1


def window_hashes(h: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """One hash for each run of ``width`` hashes in a row (over the ends of documents, too)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = np.uint64(0xD6E8FEB86659FD93 ^ salt)
    out = h[:n].copy()
    for i in range(1, width):
        out *= base
        out += h[i : i + n]
    return mix(out)
