"""Vectorised views of Arrow string columns: bytes, words and their hashes.

A column slice of half a megabyte is handled at a time, so that a task's memory does not follow
the size of an Arrow batch. Words are maximal runs of bytes other than space and 0x09-0x0D.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Odd multipliers and shifts of a 64-bit finaliser and of a polynomial hash.
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15
SLICE_BYTES = 512 << 10


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base & (2**64 - 1), np.uint64)
    out[0] = 1
    np.multiply.accumulate(out, out=out)
    return out[:n]


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES)
        have = (powers(BASE, size), powers(pow(BASE, -1, 2**64), size))
        if size <= 4 * SLICE_BYTES:
            _POWERS[0] = have
    return have


@dataclass
class Texts:
    """`data` holds the UTF-8 bytes of len(starts)-1 texts, one after another; nulls are empty."""

    data: np.ndarray
    starts: np.ndarray
    first: int  # row of the first text in its batch

    def __len__(self) -> int:
        return len(self.starts) - 1

    def raw(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.starts[i + 1]].tobytes()


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """The texts of a string column in slices of about `limit` bytes and at least one text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64, n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None and data_buffer.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield Texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i)
        i = j


@dataclass
class Words:
    """Words of a slice: byte ranges, the text of each, and for text t the words first[t]:first[t+1]."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray


def words(texts: Texts) -> Words:
    data, n = texts.data, len(texts)
    inside = np.zeros(len(data) + 1, bool)
    np.logical_not((data == 32) | ((data >= 9) & (data <= 13)), out=inside[:-1])
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    cut = texts.starts[:-1][texts.starts[:-1] < len(data)]
    begins[cut] |= inside[cut]  # a text starts a new word even where the one before ends in one
    ends = inside[:-1] & ~inside[1:]
    stop = texts.starts[1:] - 1
    stop = stop[(stop >= 0) & (texts.starts[1:] > texts.starts[:-1])]
    ends[stop] |= inside[stop]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, texts.starts, side="left")
    return Words(start, end, np.repeat(np.arange(n), np.diff(first)), first)


def byte_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte * BASE**position, from which the hash of any range follows."""
    up, _ = _tables(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def range_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges; equal bytes have equal hashes wherever they stand."""
    _, down = _tables(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def grams(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of each n consecutive items (len - n + 1 of them)."""
    size = max(0, len(hashes) - n + 1)
    out = np.full(size, np.uint64(seed))
    for i in range(n):
        out *= np.uint64(BASE)
        out += hashes[i : i + size]
    return mix(out)


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each `width` consecutive values (len - width + 1 of them)."""
    size, have, out = len(values) - width + 1, 1, values
    if size <= 0:
        return values[:0]
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out[:size]


def runs(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open ranges, as maximal disjoint ranges in ascending order."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    fresh = np.ones(len(start), bool)
    fresh[1:] = start[1:] > reach[:-1]
    at = np.flatnonzero(fresh)
    return start[at], reach[np.append(at[1:], len(start)) - 1]
