"""Vectorised scans of text columns: bytes, words, and hashes of words.

Everything here works on one Arrow batch inside a task, in slices of bounded size, so memory does
not follow the batch.  A word is a run of bytes other than space and 0x09-0x0D; multi-byte
characters never hold those bytes, so working on UTF-8 is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 512 << 10
_BASE = 0x9E3779B97F4A7C15 | 1
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Texts:
    """Some whole texts as one byte array; text i is data[offsets[i]:offsets[i + 1]], null is empty."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first, self.n = data, offsets, first, len(offsets) - 1

    def lowered(self) -> np.ndarray:
        return _LOWER[self.data]

    def prefix_hash(self, data: np.ndarray) -> np.ndarray:
        """Sums s with s[b] - s[a], times the inverse power of a, the hash of data[a:b]."""
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data) + 1)[0][: len(data)], out=out[1:])
        return out

    @staticmethod
    def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        inverse = powers(len(sums))[1]
        return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and where each text's words begin (n + 1 values)."""
        solid = ~_IS_SPACE[self.data]
        edge = self.offsets[:-1][self.offsets[:-1] < self.offsets[1:]]
        before = np.zeros(len(solid), bool)
        before[1:] = solid[:-1]
        before[edge] = False
        starts = np.flatnonzero(solid & ~before)
        after = np.zeros(len(solid), bool)
        after[:-1] = solid[1:]
        after[edge[1:] - 1] = False
        ends = np.flatnonzero(solid & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)


def texts(column: pa.Array, slice_bytes: int = SLICE_BYTES) -> Iterator[Texts]:
    """The column's texts in order, in slices of about slice_bytes; a longer text is a slice of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + slice_bytes, "right")) - 1
        end = min(max(end, at + 1), n)
        yield Texts(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], at)
        at = end


def slices(batch: pa.RecordBatch, column: int, slice_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch's rows in order, in parts with about slice_bytes in the text column; a longer text is a part of its own."""
    for t in texts(batch.column(column), slice_bytes):
        yield batch.slice(t.first, t.n)


def windows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each run of `size` words inside one text, and where each text's runs begin.

    The hash at position p covers words p to p + size - 1.  Texts with fewer words have no run.
    """
    counts = np.maximum(np.diff(first) - size + 1, 0)
    begin = np.zeros(len(first), np.int64)
    np.cumsum(counts, out=begin[1:])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], counts) + np.repeat(first[:-1], counts)
    out = np.full(len(at), np.uint64(size))
    for k in range(size):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + hashes[at + k])
    return out, begin
