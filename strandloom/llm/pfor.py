"""Patched frame-of-reference blocks of unsigned 32-bit integers.

A block holds BLOCK values less their minimum, packed at a width that a percentile of them needs. What does
not fit is an exception: its place and its high bits follow the packed bits. A block's start, minimum, width
and number of exceptions are in an index, so any block can be decoded alone.
"""

from __future__ import annotations

import numpy as np

BLOCK = 512
INDEX = np.dtype([("start", "<u8"), ("least", "<u4"), ("width", "u1"), ("exceptions", "<u2")])
EXCEPTION = np.dtype([("place", "<u2"), ("high", "<u4")])


def widths(x: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64 values below 2 ** width -> rows of width 64-bit numbers."""
    columns = np.ascontiguousarray(values.reshape(-1, 64).T).astype(np.uint64)
    out = np.zeros((width, columns.shape[1]), np.uint64)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        out[word] |= columns[j] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= columns[j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T)


def unpack(packed: np.ndarray, width: int) -> np.ndarray:
    columns = np.ascontiguousarray(packed.reshape(-1, width).T)
    out = np.empty((64, columns.shape[1]), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        value = columns[word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | (columns[word + 1] << np.uint64(64 - shift))
        out[j] = value & mask
    return np.ascontiguousarray(out.T).astype(np.uint32)


def encode(values: np.ndarray, percentile: float = 0.98, start: int = 0) -> tuple[bytes, np.ndarray]:
    """Whole blocks (a last short one is filled with its minimum) -> their bytes and index; start: the first byte's place in the file."""
    n = -(-len(values) // BLOCK)
    if not n:
        return b"", np.zeros(0, INDEX)
    full = np.empty(n * BLOCK, np.uint32)
    full[: len(values)] = values
    full[len(values) :] = values[(n - 1) * BLOCK :].min()
    full = full.reshape(n, BLOCK)
    least = full.min(axis=1)
    rest = full - least[:, None]
    pivot = min(BLOCK - 1, int(percentile * BLOCK))
    width = np.maximum(widths(np.partition(rest, pivot, axis=1)[:, pivot]), 1)
    over = (rest >> np.minimum(width, 31).astype(np.uint32)[:, None]) > 0
    over[width >= 32] = False
    number = over.sum(axis=1)
    index = np.zeros(n, INDEX)
    index["least"], index["width"], index["exceptions"] = least, width, number
    size = width * (BLOCK // 8) + number * EXCEPTION.itemsize
    at = np.cumsum(size) - size
    index["start"] = at + start
    out = np.empty(int(size.sum()), np.uint8)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        bits = rest[rows] & np.uint32((1 << int(w)) - 1)
        body = pack(bits, int(w)).view(np.uint8).reshape(len(rows), -1)
        out[at[rows][:, None] + np.arange(body.shape[1])] = body
    row, place = np.nonzero(over)
    if len(row):
        patches = np.zeros(len(row), EXCEPTION)
        patches["place"], patches["high"] = place, rest[row, place] >> width[row].astype(np.uint32)
        nth = np.arange(len(row)) - (np.cumsum(number) - number)[row]
        to = (at + width * (BLOCK // 8))[row] + nth * EXCEPTION.itemsize
        out[to[:, None] + np.arange(EXCEPTION.itemsize)] = patches.view(np.uint8).reshape(len(row), -1)
    return out.tobytes(), index


def decode(data: bytes, index: np.ndarray, start: int | None = None) -> np.ndarray:
    """The values of consecutive blocks; data begins at the first one's place in the file."""
    if not len(index):
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(data, np.uint8)
    at = (index["start"] - (index["start"][0] if start is None else np.uint64(start))).astype(np.int64)
    width, number = index["width"].astype(np.int64), index["exceptions"].astype(np.int64)
    out = np.empty((len(index), BLOCK), np.uint32)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        body = raw[at[rows][:, None] + np.arange(w * (BLOCK // 8))]
        out[rows] = unpack(body.view(np.uint64), int(w)).reshape(len(rows), BLOCK)
    if number.sum():
        row = np.repeat(np.arange(len(index)), number)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
        frm = (at + width * (BLOCK // 8))[row] + nth * EXCEPTION.itemsize
        patches = np.ascontiguousarray(raw[frm[:, None] + np.arange(EXCEPTION.itemsize)]).view(EXCEPTION).reshape(-1)
        out[row, patches["place"]] |= patches["high"] << width[row].astype(np.uint32)
    out += index["least"][:, None]
    return out.reshape(-1)
