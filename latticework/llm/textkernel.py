"""Vectorised numpy passes over Arrow text: words, hashes and shingles of many documents at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Documents are handled in slices of about so many bytes.
SLICE = 2 << 20
HASHED = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (in place)."""
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """n 64-bit constants from a seed, all odd."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


BYTES, BASE = stream(256, 1), stream(1, 2)[0]
ORDER = stream(64, 3)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a text column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    bytes_ = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return bytes_, offs - offs[0]


def slices(data: np.ndarray, offs: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole documents of about ``size`` bytes."""
    row, n = 0, len(offs) - 1
    while row < n:
        end = max(row + 1, min(n, int(np.searchsorted(offs, offs[row] + size, "right")) - 1))
        yield row, end, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the offset of each document's first word."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    ink = ~WHITE[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = ink[:-1], ink[1:]
    starts = np.flatnonzero(ink & (~before | edge[:-1]))
    ends = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


class _Powers:
    """Powers of BASE and of its inverse, as many as have been asked for, and room for one sum more."""

    up, down, room = np.ones(1, U64), np.ones(1, U64), np.zeros(1, U64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", BASE), ("down", U64(pow(int(BASE), -1, 1 << 64)))):
                powers = np.full(size, base)
                powers[0] = 1
                setattr(cls, name, np.cumprod(powers))
            cls.room = np.empty(size + 1, U64)
        return cls.up, cls.down, cls.room


def ranges(data: np.ndarray):
    """A function of starts and ends that hashes the bytes between them, each range from all its bytes.

    A range's polynomial is the difference of two running sums, shifted back by the power of its start. The sums lie in
    room that the next call uses again.
    """
    up, down, sums = _Powers.to(len(data))
    sums = sums[: len(data) + 1]
    sums[0] = 0
    np.take(BYTES, data, out=sums[1:], mode="clip")
    sums[1:] *= up[: len(data)]
    np.cumsum(sums, out=sums)
    return lambda starts, ends: mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, which are in their order, from all their bytes; about HASHED bytes at a time."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, low + HASHED)))
        high = int(ends[j - 1])
        out[i:j] = ranges(data[low:high])(starts[i:j] - low, ends[i:j] - low)
        i = j
    return out


def shingles(hashes: np.ndarray, word_offs: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles in order, and each document's offsets; under k words the whole sequence is one."""
    counts = np.diff(word_offs)
    made = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    offs = np.concatenate(([0], np.cumsum(made)))
    out = np.zeros(int(offs[-1]), U64)
    if not len(out):
        return out, offs
    at = np.arange(len(out)) + np.repeat(word_offs[:-1] - offs[:-1], made)
    size = np.repeat(np.minimum(counts, k), made)
    for j in range(k):
        if (size > j).all():
            out += hashes[at + j] * ORDER[j]
        else:
            ok = size > j
            out[ok] += hashes[at[ok] + j] * ORDER[j]
    return mix(out + size.astype(U64)), offs


def distinct(values: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each document, and their offsets."""
    if not len(values):
        return values, np.zeros_like(offs)
    values = values.copy()
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        if b - a > 1:
            values[a:b].sort()
    keep = np.empty(len(values), bool)
    keep[0] = True
    keep[1:] = values[1:] != values[:-1]
    keep[offs[:-1][offs[:-1] < len(values)]] = True
    total = np.concatenate(([0], np.cumsum(keep)))
    return values[keep], total[offs]


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each document's sorted distinct shingle hashes of its A-Z-lowered words, and offsets."""
    data = LOWER[data]
    starts, ends, word_offs = words(data, offs)
    return distinct(*shingles(word_hashes(data, starts, ends), word_offs, k))


def longs(values: np.ndarray, offs: np.ndarray) -> pa.Array:
    """list<int64> from 64-bit values and offsets."""
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(values.view(np.int64)))
