"""Sequence packing: non-negative least squares over length combinations, residuals packed greedily.

A document's ids are cut into full windows and a remainder. Remainders are gathered in blocks of about
`block_tokens` ids. For a block, shallow combinations (one to three remainder lengths that fill a window exactly)
are enumerated (for each shortest length its `per_length` most frequent partners: with more of them, counts spread so thin that rounding loses
them), and non-negative least squares finds repeat counts whose lengths sum to the block's histogram.
Counts are rounded and held to what the histogram has, and what that leaves is solved for again. What is left then is packed greedily, longest first, and cut
where a window is full; the open window goes on in the next block, so a task pads one sequence at most.

Blocks are local to a task: no shuffle, bounded memory, and the padding share falls with the input.

Cases: null and empty texts are the end id alone. An empty table gives no pieces. Equal rows are packed each on
its own. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .text import slices
from .tokens import encoder

NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def combinations(histogram: np.ndarray, window: int, per_length: int = 4) -> np.ndarray:
    """Rows of three lengths (0: none) that sum to window, from lengths that occur; for each shortest length the per_length most frequent partners."""
    have = np.flatnonzero(histogram)
    have = have[have > 0]
    pairs = [(0, a, window - a) for a in have.tolist() if a <= window - a and window - a < len(histogram) and histogram[window - a]]
    triples = []
    for a in have[have <= window // 3].tolist():
        b = have[(have >= a) & (have <= (window - a) // 2)]
        c = window - a - b
        ok = (c < len(histogram)) & (histogram[np.minimum(c, len(histogram) - 1)] > 0)
        b = b[ok]
        if len(b) > per_length:
            b = b[np.argsort(-np.minimum(histogram[b], histogram[window - a - b]), kind="stable")[:per_length]]
        triples += [(a, x, window - a - x) for x in b.tolist()]
    return np.array(pairs + triples, np.int64).reshape(-1, 3)


def non_negative_least_squares(rows: np.ndarray, histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """x >= 0 with least ||A x - histogram||, by projected gradients with momentum; column i of A counts the lengths in rows[i]."""
    target = histogram.astype(np.float64).copy()
    target[0] = 0
    flat, size = rows.reshape(-1), len(histogram)
    used = (rows > 0).astype(np.float64)

    def times(x):
        out = np.bincount(flat, (x[:, None] * used).reshape(-1), size)
        return out

    def gradient(x):
        return ((times(x) - target)[rows] * used).sum(axis=1)

    use = np.bincount(flat, used.reshape(-1), size)
    step = 1 / np.maximum(1, (use[rows] * used).sum(axis=1))
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(rounds):
        z = np.maximum(0, y - step * gradient(y))
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = z, z + (t - 1) / s * (z - x), s
    return x


def plan(histogram: np.ndarray, window: int, solves: int = 4) -> list[tuple[tuple[int, ...], int]]:
    """(lengths that fill a window, times); never more of a length than the histogram has. What rounding leaves is solved for again, `solves` times at most."""
    left, out = histogram.copy(), []
    for _ in range(solves):
        rows = combinations(left, window)
        if not len(rows):
            break
        x = non_negative_least_squares(rows, left)
        before = len(out)
        for i in np.argsort(-x, kind="stable").tolist():
            lengths = [a for a in rows[i].tolist() if a]
            need = {a: lengths.count(a) for a in lengths}
            times = min([int(x[i] + 0.5), *(int(left[a]) // k for a, k in need.items())])
            if times > 0:
                for a, k in need.items():
                    left[a] -= k * times
                out.append((tuple(lengths), times))
        if len(out) == before:
            break
    return out


class Packer:
    """Takes documents, gives pieces (doc_id, start, ids, doc_tokens, sequence_id, offset)."""

    def __init__(self, window: int, first_id: int, block_tokens: int):
        self.window, self.block_tokens = window, block_tokens
        self.next_id, self.open, self.fill = first_id, None, 0
        self.rest, self.held = [], 0

    def new(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def add(self, doc_id, ids: np.ndarray):
        full = len(ids) // self.window * self.window
        for at in range(0, full, self.window):
            yield doc_id, at, ids[at : at + self.window], len(ids), self.new(), 0
        if full < len(ids):
            self.rest.append((doc_id, full, ids[full:], len(ids)))
            self.held += len(ids) - full
        if self.held >= self.block_tokens:
            yield from self.flush()

    def flush(self):
        by_length: dict[int, list] = {}
        for piece in self.rest:
            by_length.setdefault(len(piece[2]), []).append(piece)
        histogram = np.zeros(self.window, np.int64)
        for length, pieces in by_length.items():
            histogram[length] = len(pieces)
            pieces.reverse()
        for lengths, times in plan(histogram, self.window):
            for _ in range(times):
                sequence, offset = self.new(), 0
                for length in lengths:
                    yield (*by_length[length].pop(), sequence, offset)
                    offset += length
        for length in sorted(by_length, reverse=True):
            for doc_id, start, ids, total in reversed(by_length[length]):
                while len(ids):
                    if self.open is None:
                        self.open, self.fill = self.new(), 0
                    part = ids[: self.window - self.fill]
                    yield doc_id, start, part, total, self.open, self.fill
                    self.fill += len(part)
                    start, ids = start + len(part), ids[len(part) :]
                    if self.fill == self.window:
                        self.open = None
        self.rest, self.held = [], 0


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, window: int = 2048, with_ids: bool = True, block_tokens: int = 1 << 20) -> DataFrame:
    """docs (doc_id, text, ...) -> one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked, ids."""
    names = NAMES + ["ids"] * with_ids
    def rows(pieces):
        out = [[] for _ in NAMES]
        parts = []
        for doc_id, start, ids, total, sequence, offset in pieces:
            for column, value in zip(out, (doc_id, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()), total, sequence, offset)):
                column.append(value)
            parts.append(ids)
        columns = [pa.array(c, pa.int64()) for c in out]
        if with_ids:
            ends = np.cumsum([0, *map(len, parts)])
            columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint32), *parts]).astype(np.int32))))
        return pa.RecordBatch.from_arrays(columns, names)

    def pack(batches):
        coder = encoder(tokenizer, end_id)
        packer = Packer(window, TaskContext.get().partitionId() << 36, block_tokens)
        for batch in slices(batches, size=4 << 20):
            ids, bounds = coder.encode(batch.column("text"))
            found = []
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                found += packer.add(doc_id, ids[bounds[i] : bounds[i + 1]])
            yield rows(found)
        yield rows(packer.flush())

    schema = ", ".join(f"{name} long" for name in NAMES) + ", ids array<int>" * with_ids
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pack, schema)
