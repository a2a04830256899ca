"""Vectorised text kernels: whole Arrow string columns become word, line and n-gram hashes in numpy.

Words are maximal runs of bytes other than space and 0x09-0x0D. UTF-8 never uses those bytes inside a
character, so working on bytes is exact. Hashes have 64 bits.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_U = np.uint64

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE_VALUES = np.random.RandomState(20240611).randint(1, 2**63 - 1, 256).astype(_U) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def up(base: int) -> np.ndarray:
        out = np.full(n, base, _U)
        out[0] = 1
        return np.cumprod(out, dtype=_U)

    return up(_BASE), up(_INVERSE)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(2 * SLICE_BYTES, 1 << int(n).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply)."""
    x = x ^ (x >> _U(31))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    return x


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """(first, end) runs of documents of about limit bytes; one longer document is a run of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end
        first = end


class Spans:
    """Runs of bytes inside documents: starts, ends, and bounds[d]:bounds[d+1] are those of document d."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray, doc_offsets: np.ndarray):
        self.starts, self.ends = starts, ends
        self.bounds = np.searchsorted(starts, doc_offsets)
        self.bounds[-1] = len(starts)

    @property
    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def runs(inside: np.ndarray, doc_offsets: np.ndarray) -> Spans:
    n = len(inside)
    if not n:
        return Spans(np.zeros(0, np.int64), np.zeros(0, np.int64), doc_offsets)
    cut = np.zeros(n + 1, bool)
    cut[doc_offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return Spans(starts, ends, doc_offsets)


def words(data: np.ndarray, doc_offsets: np.ndarray) -> Spans:
    return runs(~SEPARATOR[data], doc_offsets)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] that depend on the bytes only."""
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(_U))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive values, by its start; the caller masks runs that leave a document."""
    if len(hashes) < n:
        return np.zeros(0, _U)
    m = len(hashes) - n + 1
    out = np.zeros(m, _U)
    for i in range(n):
        out *= _U(_BASE)
        out += hashes[i : i + m]
    return mix(out)


def window_starts(bounds: np.ndarray, n: int) -> np.ndarray:
    """For each position that could start an n-gram of the flat sequence: is the n-gram inside one document?"""
    total = int(bounds[-1])
    if total < n:
        return np.zeros(0, bool)
    ok = np.ones(total, bool)
    for back in range(1, n):
        at = bounds[1:] - back
        ok[at[(at >= bounds[:-1]) & (at >= 0)]] = False
    return ok[: total - n + 1]


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of total positions lie in one of the length-n windows at starts."""
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[d]:bounds[d+1]] for each d, empty runs included."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
