"""Texts as numpy arrays: words, their hashes and windows of words, whole batches at a time.

A word is a longest run of bytes other than 0x20 and 0x09 to 0x0D, so UTF-8 can be split byte by byte.
Hashes are 64 bits wide; two independent ones serve where equality decides a result.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def numbers(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed * 0xD1342543DE82EF95 % 2**64))


BYTE_VALUES = [numbers(256, seed) | U(1) for seed in (1, 2)]
BASES = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string()).cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def give_back() -> None:
    """Let the system have what a task has freed, where the C library can; else a worker holds its peak until the next task."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about size bytes of text, short batches joined and long ones cut; a longer text is a batch of its own."""
    held, weight = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        lo = 0
        for hi, length in enumerate(lengths.tolist(), 1):
            weight += length
            if weight >= size:
                held.append(batch.slice(lo, hi - lo))
                yield _joined(held)
                held, weight, lo = [], 0, hi
        if lo < batch.num_rows:
            held.append(batch.slice(lo))
    if held:
        yield _joined(held)
        held = []
    give_back()


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.concat_batches(held)


class Words:
    """The words of some texts: start and end bytes, and first[i], the number of words before text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        space = SPACE[data]
        inside = ~space
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= space[:-1]
        end[:-1] &= space[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        begin[cut] |= inside[cut]
        end[cut - 1] |= inside[cut - 1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, offsets)
        self._inside = inside

    def __len__(self) -> int:
        return len(self.start)

    @property
    def text(self) -> np.ndarray:
        """Of each word, the row it is in."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def coded(self) -> tuple[np.ndarray, pa.Array]:
        """Of each word a number, and the different words by number."""
        offsets = np.zeros(len(self) + 1, np.int64)
        np.cumsum(self.end - self.start, out=offsets[1:])
        plain = self.data[self._inside]
        array = pa.Array.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(offsets), pa.py_buffer(plain)])
        found = array.dictionary_encode()
        return found.indices.to_numpy(zero_copy_only=False), found.dictionary

    def hashes(self, kinds: int = 1) -> list[np.ndarray]:
        code, words = self.coded()
        return [h[code] for h in hash_words(words, kinds)]


def hash_words(words: pa.Array, kinds: int = 1) -> list[np.ndarray]:
    """kinds independent 64-bit hashes of each value of a large_binary array without empty values."""
    if not len(words):
        return [np.zeros(0, U)] * kinds
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    length = np.diff(offsets)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], length)
    out = []
    for values, base in zip(BYTE_VALUES[:kinds], BASES):
        power = np.cumprod(np.full(int(length.max()), base, U))
        out.append(mix(np.add.reduceat(values[data] * power[place], offsets[:-1]) + length.astype(U)))
    return out


def windows(h: np.ndarray, width: int, kind: int = 0) -> np.ndarray:
    """Hash of each run of width neighbours of h, by doubling: a run of 2 n joins two runs of n."""
    if len(h) < width:
        return np.zeros(0, U)
    done, out, base = 0, None, BASES[kind]
    power, run, length = base, h, 1
    rest = width
    while rest:
        if rest & 1:
            n = len(h) - done - length + 1
            out = run[done : done + n].copy() if out is None else out[:n] * power + run[done : done + n]
            done += length
        rest >>= 1
        if rest:
            run = run[: len(run) - length] * power + run[length:]
            length *= 2
            power = U(int(power) * int(power) % 2**64)
    return out[: len(h) - width + 1]


def sliding(a: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """best over each run of width neighbours."""
    if len(a) < width:
        return a[:0]
    length, run = 1, a
    while 2 * length <= width:
        run = best(run[: len(run) - length], run[length:])
        length *= 2
    n = len(a) - width + 1
    return best(run[:n], run[width - length : width - length + n])
