"""Vectorised word kernels over Arrow string buffers.

All functions work on slices of whole documents (a document is never cut), so
temporary arrays stay small: a slice holds about ``SLICE_BYTES`` of text, or
one document if that alone is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for later calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_table(lower: bool = True) -> np.ndarray:
    """One odd 64-bit value per byte; A-Z share those of a-z if ``lower``."""
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    if lower:
        table[65:91] = table[97:123]
    return table


def word_class(separators: bytes) -> np.ndarray:
    """True for each byte that belongs to a word."""
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


_TABLE = byte_table()

#: Words of shingles: everything but space and \t..\r.
SPACED = word_class(bytes([0x20, *range(0x09, 0x0E)]))
#: Words of contamination: digits, letters a-z in either case, and all non-ASCII.
ALNUM = word_class(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def slices(text: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows; null counts as empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if text.null_count:
        text = text.fill_null("")
    if not pa.types.is_large_string(text.type):
        text = text.cast(pa.large_string())
    n = len(text)
    if not n:
        return
    _, offs, data = text.buffers()
    offs = np.frombuffer(offs, dtype=np.int64)[text.offset : text.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offs, offs[row] + limit, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def words(data: np.ndarray, offs: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, index of each row's first word with the total at the end)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    inside = member[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    before &= ~edge[:-1]
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after &= ~edge[1:]
    end = np.flatnonzero(inside & ~after) + 1
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_TABLE[data] * _power(_BASE, n), out=sums[1:])
    value = (sums[end] - sums[start]) * _power(_INVERSE, n)[start]
    value += (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(value), np.searchsorted(start, offs)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> list[np.ndarray]:
    """Each row's sorted distinct shingle hashes; a row of fewer words has one, of none none."""
    n = len(hashes)
    total = np.zeros(max(0, n - width + 1), dtype=np.uint64)
    for j in range(width):
        total += hashes[j : n - width + 1 + j] * np.uint64(pow(0xC2B2AE3D27D4EB4F, j + 1, 1 << 64))
    total = mix(total)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            row = np.sort(total[a : b - width + 1])
            keep = np.empty(len(row), dtype=bool)
            keep[0] = True
            np.not_equal(row[1:], row[:-1], out=keep[1:])
            out.append(row[keep])
        elif b > a:
            factors = np.array([pow(0x9FB21C651E98DF25, j + 1, 1 << 64) for j in range(b - a)], dtype=np.uint64)
            value = (hashes[a:b] * factors).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([value], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
