"""Vectorised text kernels shared by the corpus operators.

Everything here works on an Arrow string column as one byte buffer with offsets, so that the cost of a
document is a handful of numpy passes over its bytes and no Python object per word.  Batches are cut
into slices of about ``SLICE_BYTES`` so that the working set of a worker stays bounded; a longer
document forms a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21

_U = np.uint64
_RADIX = _U(0x9E3779B97F4A7C15)
_RADIX_INV = _U(pow(int(_RADIX), -1, 1 << 64))


def _random_words(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, n, dtype=np.uint64) | _U(1)


_BYTE = _random_words(256, 17)
#: The same values for A-Z and a-z: hashing lower-cases ASCII letters only.
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_STEP = _random_words(64, 29)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the radix and of its inverse, for positions below n."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, SLICE_BYTES + 1)
        one = np.ones(size, dtype=np.uint64)
        for base, name in ((_RADIX, "p"), (_RADIX_INV, "i")):
            step = np.full(size, base, dtype=np.uint64)
            step[0] = 1
            one = np.cumprod(step, dtype=np.uint64)
            if name == "p":
                _powers = one
            else:
                _inverses = one
    return _powers, _inverses


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; equal in, equal out, and all bits depend on all bits."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(29)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(32)
    return h


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive slices of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(n, max(end, first + 1))
        lo, hi = int(offsets[first]), int(offsets[end])
        yield first, end, raw[lo:hi], offsets[first : end + 1] - lo
        first = end


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without ASCII white space, and each document's first word's index."""
    return runs(~_SPACE[buf], offsets)


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that do not cross documents: starts, ends, index of each document's first run."""
    n = len(member)
    if not n:
        z = np.zeros(0, dtype=np.int64)
        return z, z, np.zeros(len(offsets), dtype=np.int64)
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = member[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = member[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    starts = np.flatnonzero(member & ~before)
    ends = np.flatnonzero(member & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever the span lies."""
    n = len(buf)
    power, inverse = _tables(n + 1)
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[buf] * power[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word with A-Z lower-cased, and the index of each document's first word (one more entry than documents)."""
    starts, ends, first = word_spans(buf, offsets)
    return span_hashes(buf, starts, ends), first


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of ``width`` consecutive values; windows may cross documents, the caller masks those."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = h[:n] * _STEP[0]
    for k in range(1, width):
        total = total + h[k : k + n] * _STEP[k]
    return mix(total)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """For each document the sorted distinct hashes of its word shingles; with fewer words one for the whole sequence."""
    h, first = word_hashes(buf, offsets)
    w = windows(h, width)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(w[a : b - width + 1])
        elif b > a:
            yield mix(np.sum(h[a:b] * _STEP[: b - a], dtype=np.uint64, keepdims=True) + _U(b - a))
        else:
            yield np.zeros(0, dtype=np.uint64)
