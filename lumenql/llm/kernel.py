"""Vectorised byte and word kernels shared by the corpus operators.

Everything here works on the UTF-8 bytes of a *batch* of texts at once: the Arrow buffers are
viewed by numpy without a copy, a prefix-sum hash gives the fingerprint of any byte range in
O(1), and word boundaries come from one table lookup per byte.  No function loops over
characters or words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Separators of the word definition [^\x20\x09-\x0D]+ ; all are ASCII, so bytes suffice.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_SLOT = _rng.integers(0, 2**63, 64, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values one after the other, and n + 1 offsets; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def slices(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that the texts of each hold at most `limit` bytes (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, ends = utf8(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


class Ranges:
    """Fingerprints of byte ranges: of(i, j) depends on the bytes i..j-1 only."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(_BYTE[data] * _power(_INVERSE, n), out=self.sums[1:])
        self.scale = _power(_BASE, n + 1)

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return mix((self.sums[j] - self.sums[i]) * self.scale[i] + (j - i).astype(U64) * _SLOT[0])

    def windows(self, size: int) -> np.ndarray:
        """Fingerprints of all ranges of `size` bytes."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, U64)
        return mix((self.sums[size:] - self.sums[:n]) * self.scale[:n])


def words(data: np.ndarray, ends: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprints, starts, stops, first): words of text d are first[d]..first[d + 1] - 1."""
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~SEPARATOR[data]
    first = np.zeros(n + 1, bool)
    first[ends] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    stops = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    return Ranges(data).of(starts, stops), starts, stops, np.searchsorted(starts, ends)


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, begin): of all runs of `size` words, text by text; a text of fewer words, but one at least, has one for its whole sequence."""
    counts = np.diff(first)
    many = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    begin = np.concatenate([[0], np.cumsum(many)])
    total = int(begin[-1])
    at = np.arange(total) - np.repeat(begin[:-1], many) + np.repeat(first[:-1], many)
    long = np.repeat(counts, many)
    h = np.zeros(total, U64)
    padded = np.concatenate([hashes, np.zeros(size, U64)])
    for k in range(size):
        h += np.where(k < long, padded[at + k] * _SLOT[k + 1], U64(0))
    return mix(h + np.minimum(long, size).astype(U64) * _SLOT[0]), begin


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, by doubling."""
    have, span = values, 1
    while span < width:
        step = min(span, width - span)
        have = np.minimum(have[:-step], have[step:]) if len(have) > step else have[:0]
        span += step
    return have


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    s = np.sort(keys)
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, begin): a stable order that brings equal keys together and where each group begins, with the end."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return order, np.append(begin, len(s))
