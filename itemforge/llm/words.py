"""Words and their 64-bit hashes for a whole Arrow column at once, in numpy.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z. The hash of any byte
range comes from prefix sums of a polynomial hash, so that no Python code runs per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20240501)).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
SLICE_BYTES = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64 bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_LOW, _LOW_INVERSE = _powers(_BASE, 4096), _powers(_INVERSE, 4096)


def _power(n: int) -> np.ndarray:
    high = _powers(pow(_BASE, 4096, 1 << 64), -(-n // 4096) or 1)
    return (high[:, None] * _LOW[None, :]).ravel()[:n]


def _inverse(at: np.ndarray, n: int) -> np.ndarray:
    high = _powers(pow(_INVERSE, 4096, 1 << 64), n // 4096 + 1)
    return high[at >> 12] * _LOW_INVERSE[at & 4095]


class RangeHash:
    """Hashes of ranges of one buffer; equal ranges have equal hashes in every buffer."""

    def __init__(self, values: np.ndarray):
        """values: bytes, or hashes of words."""
        self.n = len(values)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum((_BYTE[values] if values.dtype == np.uint8 else values) * _power(self.n), out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * _inverse(start, self.n) + (end - start).astype(np.uint64))


class Texts:
    """The texts of an Arrow string column: bytes, document offsets, words."""

    def __init__(self, column: pa.Array, lower: bool = True, other: np.ndarray | None = None):
        column = column.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(column) and column.buffers()[2] else np.zeros(0, np.uint8)
        self.raw, self.offsets, self.n = raw, offsets - offsets[0], len(column)
        self.data = _LOWER[raw] if lower else raw
        inside = ~(_SPACE if other is None else other)[self.data]
        first = np.zeros(len(inside) + 1, bool)
        first[self.offsets] = True
        before = np.zeros_like(inside)
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | first[:-1]))
        after = np.zeros_like(inside)
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | first[1:])) + 1
        #: Words of document i: first[i] to first[i + 1].
        self.first = np.searchsorted(self.start, self.offsets)
        self.doc = np.repeat(np.arange(self.n), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        self.ranges = RangeHash(self.data)
        return self.ranges(self.start, self.end)


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k values (as many as fit, wherever a document ends)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, U(k), np.uint64)
    for j in range(k):
        out = mix(out * U(0xD6E8FEB86659FD93) + hashes[j : j + n])
    return out


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of k words; of all its words if there are fewer."""
    t = Texts(column)
    h = t.hashes()
    whole, out = runs(h, k), []
    for a, b in zip(t.first[:-1].tolist(), t.first[1:].tolist(), strict=True):
        out.append(np.unique(whole[a : b - k + 1]) if b - a >= k else runs(h[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batch of about limit bytes of text, one row at least."""
    if not batch.num_rows:
        return
    lengths = np.cumsum(pa.compute.binary_length(batch.column(column).cast(pa.large_binary()).fill_null(b"")).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = lengths[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(lengths, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def crc32_of(ids: list) -> np.ndarray:
    """crc32 of each id as text; of a null id 0."""
    import zlib

    return np.array([0 if x is None else zlib.crc32(str(x).encode()) for x in ids], np.uint32)


def trim() -> None:
    """Give freed memory back to the system: workers are used again, and share an executor's memory with its JVM."""
    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if free is not None:
        free(0)


def binary(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in rows], pa.binary())


import pyarrow.compute  # noqa: E402  slices() reaches it as pa.compute
