"""Benchmark decontamination: SimHash fingerprints of item-sized windows, multi-index Hamming search, exact verification.

An item of m words is looked for in every window of m words of a document (in the whole document, if that is shorter).
Windows that share no shingle with the benchmark can't be similar to any item and are passed over; the others get a SimHash
of BITS bits of their shingles, in which each occurrence of a shingle in the window counts as one of its own. Items of a size are indexed by BLOCKS blocks of
16 bits of their fingerprints: two fingerprints within RADIUS = 59 differ in at most 59 // 16 = 3 bits in some block. The index holds each item's blocks with up to
two bits turned, and a window's blocks are looked up with up to one bit turned, so every item within the radius is found, whatever else is. About one item in six
is met so by chance in some block; what is within RADIUS over all bits (about none by chance: 59 of 256, where half are expected) is verified by
the weighted Jaccard similarity of the shingles, sum of least over sum of greatest counts.

RADIUS: so similarity s, also of repeated shingles, is that of two flat sets and means a cosine of about 2 s / (1 + s), for 0.8 an
angle of 27 degrees, 38.8 of 256 bits in the mean with a deviation of 5.7; 59 bits are three and a half deviations above. Windows are aligned to the word, so
a passage copied whole has distance 0. Recall at similarities just above 0.8 is measured in the tests.

The benchmark goes to the executors in slices of at most `slice_bytes` of text and `slice_items` items, which bounds an index to about 70 MB; a larger one takes several
passes over the documents (a benchmark doesn't grow with the corpus). Documents are never shuffled.

Cases: null or wordless texts and items match nothing. Items of fewer than `n` words have one shingle, the whole. Rows that
repeat an item_id are items of their own with one id. Equal documents match alike. Other columns are untouched. Without items nothing matches.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .text import Words, mix, slices, utf8, windows

BITS, BLOCKS, RADIUS = 256, 16, 59
MATCHES = "array<struct<item_id:long,start:int,words:int,similarity:double>>"
MATCH_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("words", pa.int32()), ("similarity", pa.float64())]))
ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the word n-grams; of fewer than n words one of them all."""
    if not len(h):
        return h
    n = min(n, len(h))
    return mix(windows(h, n) + np.uint64(n))


def masks(bits: int) -> np.ndarray:
    """The 16-bit numbers of at most `bits` ones."""
    return np.array([x for x in range(1 << 16) if x.bit_count() <= bits], np.uint32)


ITEM_MASKS, WINDOW_MASKS = masks(2), masks(1)
BLOCK = (np.arange(BLOCKS, dtype=np.uint32) << 16)[:, None]


def fingerprints(found: np.ndarray, size: int) -> np.ndarray:
    """SimHash of each run of size shingles, as rows of BITS / 8 bytes; the second, third ... occurrence of a shingle in a run has bits of its own."""
    def bits(nth):
        seeds = found + np.uint64(0xABCD) + nth * np.uint64(0x9E3779B97F4A7C15)
        words = np.stack([mix(seeds + np.uint64(part * 0xD1342543DE82EF95 % 2**64)) for part in range(BITS // 64)], axis=1)
        return np.unpackbits(words.view(np.uint8), axis=1).view(np.int8) * np.int8(2) - np.int8(1)

    def summed(rows):
        return np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(rows, axis=0, dtype=np.int32)])

    length = len(found)
    code = np.unique(found, return_inverse=True)[1].astype(np.int64) * (2 * length + 1)
    if not length or code.max() // (2 * length + 1) == length - 1:  # no shingle occurs twice
        coming = going = summed(bits(np.uint64(0)))
    else:
        at = np.arange(length)
        key = np.sort(code + at)
        place = np.searchsorted(key, code + at)
        # How often a shingle occurs in the run that it ends, and in the run that it begins.
        coming = summed(bits((place - np.searchsorted(key, code + np.maximum(at - size + 1, 0))).astype(np.uint64)))
        going = summed(bits((np.searchsorted(key, code + at + size) - place - 1).astype(np.uint64)))
    return np.packbits(coming[size:] - going[: len(coming) - size] > 0, axis=1)


def similarity(a: Counter, b: Counter) -> float:
    common = sum(min(count, b[key]) for key, count in a.items() if key in b)
    return common / (sum(a.values()) + sum(b.values()) - common)


class Items:
    """Items of one word count."""

    def __init__(self, rows: list[tuple[int, np.ndarray]]):
        self.ids = [item_id for item_id, _ in rows]
        self.counts = [Counter(found.tolist()) for _, found in rows]
        self.prints = np.concatenate([fingerprints(found, len(found)) for _, found in rows])
        self.index: tuple[np.ndarray, np.ndarray] | None = None

    def _indexed(self) -> tuple[np.ndarray, np.ndarray]:
        """Blocks of items, each with up to two bits turned, ascending, and the items; made where it is first asked for."""
        if self.index is None:
            key = (BLOCK + (self.prints.view("<u2").astype(np.uint32)[:, :, None] ^ ITEM_MASKS)).reshape(-1)
            by = np.argsort(key, kind="stable")
            self.index = key[by], (by // (BLOCKS * len(ITEM_MASKS))).astype(np.int32)
        return self.index

    def candidates(self, prints: np.ndarray, step: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within RADIUS."""
        key, items = self._indexed()
        pairs = []
        for at in range(0, len(prints), step):
            asked = BLOCK + (np.ascontiguousarray(prints[at : at + step]).view("<u2").astype(np.uint32)[:, :, None] ^ WINDOW_MASKS)
            asked = asked.reshape(-1)
            lo, hi = np.searchsorted(key, asked), np.searchsorted(key, asked, "right")
            hit = np.flatnonzero(hi > lo)
            count = (hi - lo)[hit]
            entry = np.repeat(lo[hit] - np.cumsum(count) + count, count) + np.arange(count.sum())
            window = at + np.repeat(hit // (BLOCKS * len(WINDOW_MASKS)), count)
            pairs.append(np.unique(window * len(self.ids) + items[entry]))
        window, item = np.divmod(np.concatenate([np.zeros(0, np.int64), *pairs]), len(self.ids))
        near = ONES[prints[window] ^ self.prints[item]].sum(axis=1, dtype=np.int32) <= RADIUS
        return window[near], item[near]


class Benchmark:
    def __init__(self, rows: list[tuple[int, str]], n: int, least: float):
        self.n, self.least = n, least
        column = pa.array([text for _, text in rows], pa.string())
        data, offsets = utf8(column)
        words = Words(data, offsets, lower=True)
        h = words.hashes()[0]
        sizes: dict[int, list] = {}
        for (item_id, _), lo, hi in zip(rows, words.first, words.first[1:]):
            if hi > lo:
                sizes.setdefault(int(hi - lo), []).append((item_id, shingles(h[lo:hi], n)))
        self.sizes = {size: Items(found) for size, found in sizes.items()}
        pairs = {(int(s), size) for size, found in sizes.items() for _, some in found for s in some.tolist()}
        self.known: dict[int, np.ndarray] = {}
        self.owners: dict[int, list[int]] = {}
        for s, size in pairs:
            self.owners.setdefault(s, []).append(size)
        for width in {min(n, size) for size in sizes}:
            self.known[width] = np.array(sorted({s for s, size in pairs if min(n, size) == width}), np.uint64)

    def hits(self, h: np.ndarray, text: np.ndarray):
        """(text, first word, shingle) of each benchmark shingle in the texts."""
        for width, known in self.known.items():
            if len(h) < width:
                continue
            found = mix(windows(h, width) + np.uint64(width))
            bitmap = np.zeros(1 << 20, bool)
            bitmap[(known >> np.uint64(44)).astype(np.int64)] = True
            at = np.flatnonzero(bitmap[(found >> np.uint64(44)).astype(np.int64)])
            at = at[text[at] == text[at + width - 1]]
            place = np.searchsorted(known, found[at])
            place[place == len(known)] = 0
            at = at[known[place] == found[at]]
            yield from zip(text[at].tolist(), at.tolist(), found[at].tolist())

    def matches(self, column: pa.Array) -> list[list[dict]]:
        """Of each text, for each item in it the most similar window, the first of those."""
        data, offsets = utf8(column)
        words = Words(data, offsets, lower=True)
        out: list[list[dict]] = [[] for _ in range(len(column))]
        if not len(words) or not self.known:
            return out
        h = words.hashes()[0]
        anchors: dict[tuple[int, int], list[int]] = {}
        for text, at, shingle in self.hits(h, words.text):
            for size in self.owners[shingle]:
                anchors.setdefault((text, size), []).append(at)
        best: dict[tuple[int, int], tuple] = {}
        for (text, size), found in anchors.items():
            lo, hi = int(words.first[text]), int(words.first[text + 1])
            width = min(size, hi - lo)
            run = width - min(self.n, width) + 1
            wanted = np.zeros(hi - lo - width + 1, bool)
            for at in found:
                wanted[max(0, at - lo - run + 1) : at - lo + 1] = True
            own = shingles(h[lo:hi], min(self.n, width))
            items = self.sizes[size]
            starts = np.flatnonzero(wanted)
            for part in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                if not len(part):
                    continue
                some = own[part[0] : part[-1] + run]
                for window, item in zip(*items.candidates(fingerprints(some, run))):
                    value = similarity(Counter(some[window : window + run].tolist()), items.counts[item])
                    if value >= self.least - 1e-12:
                        key, new = (text, items.ids[item]), (-value, int(part[0] + window), width)
                        best[key] = min(best.get(key, new), new)
        for (text, item_id), (value, start, width) in sorted(best.items(), key=lambda x: (x[0][0], str(x[0][1]))):
            out[text].append({"item_id": item_id, "start": start, "words": width, "similarity": -value})
        return out


def _column(text: Column, benchmark: Benchmark) -> Column:
    @F.arrow_udf(MATCHES)
    def found(column: pa.Array) -> pa.Array:
        rows = []
        for part in slices([pa.RecordBatch.from_arrays([column], ["text"])]):
            rows += benchmark.matches(part.column("text"))
        return pa.array(rows, MATCH_TYPE)

    return found(text.cast("string"))


def benchmark_slices(benchmark: DataFrame, n: int, least: float, slice_bytes: int, slice_items: int = 4000):
    rows = small_batches(benchmark).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    total, items = rows.agg(F.sum(F.octet_length("text") + 64), F.count(F.lit(1))).first()
    slices_ = max(1, -(-(total or 0) // slice_bytes), -(-items // slice_items))
    for number in range(slices_):
        yield Benchmark([tuple(r) for r in rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices_)) == number).collect()], n, least)


def find_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 5, least: float = 0.8, slice_bytes: int = 8 << 20) -> DataFrame:
    """docs (doc_id, text, ...), benchmark (item_id, text, ...) -> doc_id, item_id, start and words of the window, similarity."""
    out = None
    for part in benchmark_slices(benchmark, n, least, slice_bytes):
        found = docs.select("doc_id", F.explode(_column(F.col("text"), part)).alias("m")).select("doc_id", "m.item_id", "m.start", "m.words", "m.similarity")
        out = found if out is None else out.union(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 5, least: float = 0.8, slice_bytes: int = 8 << 20) -> DataFrame:
    """The rows of docs that hold no item."""
    for part in benchmark_slices(benchmark, n, least, slice_bytes):
        docs = docs.filter(F.size(_column(F.col("text"), part)) == 0)
    return docs
