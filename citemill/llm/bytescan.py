"""Vectorised scans of Arrow string columns as bytes: runs, hashes, a hash table.

The texts of a batch lie end to end in one byte array; runs (words, pieces,
lines) are start and length arrays over it, so a pass costs a few array
operations however many texts there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
LONG_RUN = 256  # runs of more bytes are hashed one by one, without rounds over the whole batch
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U64)
_C1, _C2, _C3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)

#: Bytes of ASCII white space: space and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20):
    """(first row, last row + 1) of parts of ``batch`` with about ``most`` text bytes each, one row at least."""
    offsets = strings(batch.column(column))[1]
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (with eight spare zeros) and offsets of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(8, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_string())
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    out = np.zeros(last - first + 8, np.uint8)
    if last > first:
        out[:-8] = np.frombuffer(data, np.uint8)[first:last]
    return out, offsets - first


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words under which single bits spread."""
    h = (h ^ (h >> U64(30))) * _C2
    h = (h ^ (h >> U64(27))) * _C3
    return h ^ (h >> U64(31))


def hash_runs(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of runs of bytes; equal bytes, equal hash, wherever they lie."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    view = np.ndarray((len(buf) - 7,), "<u8", buffer=buf, strides=(1,))
    lens = lens.astype(np.int64)
    h = (lens.astype(U64) + U64(seed)) * _C1
    h = mix(h ^ (view[starts] & _MASK[np.minimum(lens, 8)]))
    at, live = 8, np.flatnonzero((lens > 8) & (lens <= LONG_RUN))
    while live.size:
        word = view[starts[live] + at] & _MASK[np.minimum(lens[live] - at, 8)]
        h[live] = mix((h[live] + _C1) ^ word)
        at += 8
        live = live[lens[live] > at]
    for i in np.flatnonzero(lens > LONG_RUN):
        h[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : starts[i] + lens[i]].tobytes(), seed)
    return h


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of maximal runs of True that don't cross texts, and each text's first run (one entry more than texts)."""
    n = int(offsets[-1])
    inside = inside[:n]
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[:-1][offsets[:-1] < n]
    first[edge] = inside[edge]
    edge = edge[edge > 0] - 1
    last[edge] = inside[edge]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1 - starts, np.searchsorted(starts, offsets)


class Table:
    """A hash table from 64-bit keys to their order of insertion, with array operations only."""

    def __init__(self, bits: int = 12):
        self.n, self._size(bits)

    n = 0

    def _size(self, bits: int) -> None:
        self.bits, self.keys, self.vals = bits, np.zeros(1 << bits, U64), np.full(1 << bits, -1, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Position of each key, -1 where it is missing."""
        mask = U64((1 << self.bits) - 1)
        h = np.where(h == 0, U64(1), h)
        at = (h & mask).astype(np.int64)
        seen = self.keys[at]
        out = np.where(seen == h, self.vals[at], -1)
        live = np.flatnonzero((seen != h) & (seen != 0))
        while live.size:
            at[live] = (at[live] + 1) & int(mask)
            seen = self.keys[at[live]]
            hit = seen == h[live]
            out[live[hit]] = self.vals[at[live[hit]]]
            live = live[~hit & (seen != 0)]
        return out

    def insert(self, h: np.ndarray) -> np.ndarray:
        """Adds distinct keys that are not yet there; their positions."""
        new = np.arange(self.n, self.n + len(h), dtype=np.int32)
        if (self.n + len(h)) * 2 > len(self.keys):
            used = np.flatnonzero(self.vals >= 0)
            old, vals = self.keys[used], self.vals[used]
            self._size(max(self.bits + 1, int(self.n + len(h)).bit_length() + 1))
            self._put(old, vals)
        self._put(np.where(h == 0, U64(1), h), new)
        self.n += len(h)
        return new

    def _put(self, h: np.ndarray, vals: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        at = (h & U64(mask)).astype(np.int64)
        live = np.arange(len(h))
        while live.size:
            free = live[self.vals[at[live]] < 0]
            self.keys[at[free]], self.vals[at[free]] = h[free], vals[free]  # of several, the last one stays
            live = live[self.vals[at[live]] != vals[live]]
            at[live] = (at[live] + 1) & mask


def spread(offsets: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices offsets[0] .. offsets[0] + lens[0] - 1, offsets[1] .., end to end."""
    total = int(lens.sum())
    ends = np.cumsum(lens)
    return np.arange(total) + np.repeat(offsets - (ends - lens), lens)


def spark_hash(keys: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of one long with seed 42, vectorised."""
    p1, p2, p3, p4, p5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    rot = lambda x, r: (x << U64(r)) | (x >> U64(64 - r))
    h = np.full(len(keys), U64(42) + p5 + U64(8))
    h ^= rot(keys * p2, 31) * p1
    h = rot(h, 27) * p1 + p4
    h = (h ^ (h >> U64(33))) * p2
    h = (h ^ (h >> U64(29))) * p3
    return (h ^ (h >> U64(32))).view(np.int64)
