"""Substring deduplication by level-wise doubling of repeated word windows.

A window of `width` words is a repeat if its word sequence also starts earlier: in a document with a
smaller doc_id, or earlier in the same document. Every word that a repeat covers is removed.

Levels. Lengths double up to `width`, from BASE words at most; for 20 they are 10 and 20, for 100 they are 13, 25, 50 and 100. Of each
window of the next level only its least part of this level's length (by hash) is counted, and only if that part has survived so far; a longer window
can only repeat if its least part does. Parts that occur once are sent back to their documents, windows whose least part is
among them are candidates no more, and the rest are extended to twice the length, until none survive or the length is `width`,
where 128-bit hashes decide. Levels above `width` would only find parts of what is already covered, so
doubling ends there: no candidate that survives could add a word.

All levels send back what is *first* or *single* and let the document infer the rest. So each level is
one aggregation with map-side combining, without a join on window keys: a passage in a third of all
documents is one row per map task.

Cases: null or wordless texts have no words and keep nothing. Shorter texts than a window keep all words.
Exact copies of an earlier text are removed whole (from `width` words on). Rows that repeat a doc_id with different
texts are documents of their own, in the order of their texts' hashes; rows equal in doc_id and text are one document and get equal
results. Rows without a doc_id come behind all others, likewise by their texts' hashes. Other columns are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .text import Words, mix, slices, sliding, utf8, windows

LAST = (1 << 63) - 1  # stands for a null doc_id
RESULT = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"


BASE = 15  # most words of the first level's windows


def lengths(width: int) -> list[int]:
    """Words of the windows of each level, each at most twice the one before."""
    out = [width]
    while out[0] > BASE or len(out) == 1:
        out.insert(0, (out[0] + 1) // 2)
    return out


class Level:
    """The words of a batch and the windows of its levels that may still repeat."""

    def __init__(self, batch: pa.RecordBatch, sizes: list[int], kinds: int):
        data, offsets = utf8(batch.column("text"))
        self.words, self.sizes = Words(data, offsets), sizes
        self.hashes = self.words.hashes(kinds)
        self.text = self.words.text

    def inside(self, size: int) -> np.ndarray:
        """Of each run of size words, whether it lies in one text."""
        n = max(0, len(self.words) - size + 1)
        return self.text[:n] == self.text[size - 1 :] if n else np.zeros(0, bool)

    def least(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of a level's windows, and of each window of the next level its least part."""
        found = mix(windows(self.hashes[0], self.sizes[level]))
        span = self.sizes[level + 1] - self.sizes[level] + 1
        return found, sliding(found, span)[: max(0, len(self.words) - self.sizes[level + 1] + 1)]

    def alive(self, batch: pa.RecordBatch, upto: int) -> np.ndarray:
        """Of each window of a level, whether it may repeat by what the levels below have sent back; an exact copy's windows needn't be looked at."""
        first, alive = self.words.first, self.inside(self.sizes[0])
        if upto:
            for i in np.flatnonzero(~batch.column("is_first").to_numpy(zero_copy_only=False)):
                alive[first[i] : first[i + 1]] = False
        for level in range(upto):
            found, least = self.least(level)
            longer, single = self.inside(self.sizes[level + 1]), batch.column(f"single{level}")
            for i in range(batch.num_rows):
                lo, hi = first[i], min(first[i + 1], len(longer))
                if hi <= lo or not longer[lo]:
                    continue
                own = found[lo : first[i + 1] - self.sizes[level] + 1]
                dead = own[~alive[lo : lo + len(own)]]
                if (values := single[i].values) is not None:
                    dead = np.concatenate([dead, values.to_numpy(zero_copy_only=False).view(np.uint64)])
                if len(dead):
                    dead.sort()
                    at = np.searchsorted(dead, least[lo:hi])
                    at[at == len(dead)] = 0
                    longer[lo:hi] &= dead[at] != least[lo:hi]
            alive = longer
        return alive


def _keys(batch: pa.RecordBatch, rows: np.ndarray, key: list[str]) -> list[pa.Array]:
    return [pa.array(batch.column(c).to_numpy(zero_copy_only=False)[rows].astype(np.int64)) for c in key]


def _parts(batches, sizes, upto, key):
    """Windows of a level that are the least part of a window of the next one, once for a document."""
    for batch in slices(batches):
        level = Level(batch, sizes, 1)
        alive, longer = level.alive(batch, upto), level.inside(sizes[upto + 1])
        if not longer.any():
            continue
        found, least = level.least(upto)
        span = sizes[upto + 1] - sizes[upto] + 1
        edge = np.zeros(span - 1, np.uint64)
        wanted = sliding(np.concatenate([edge, np.where(longer, least, np.uint64(0)), edge]), span, np.maximum)[: len(found)]
        chosen = np.flatnonzero((wanted == found) & (found != 0) & alive)
        rows = pd.DataFrame({"doc": level.text[chosen], "h": found[chosen]})
        again, keep = rows.duplicated(keep=False).to_numpy(), ~rows.duplicated().to_numpy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows["h"].to_numpy()[keep].view(np.int64)), *_keys(batch, rows["doc"].to_numpy()[keep], key), pa.array((1 + again[keep]).astype(np.int32))], ["h", *key, "times"]
        )


def _full_windows(batches, sizes, key):
    for batch in slices(batches):
        level = Level(batch, sizes, 2)
        found = np.flatnonzero(level.alive(batch, len(sizes) - 1))
        if not len(found):
            continue
        a, b = (mix(windows(h, sizes[-1], kind)[found]) for kind, h in enumerate(level.hashes))
        doc = level.text[found]
        keep = ~pd.DataFrame({"d": doc, "a": a, "b": b}).duplicated().to_numpy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(a[keep].view(np.int64)), pa.array(b[keep].view(np.int64)), *_keys(batch, doc[keep], key), pa.array((found - level.words.first[doc])[keep].astype(np.int32))],
            ["a", "b", *key, "start"],
        )


def _removed(batches, sizes):
    width = sizes[-1]
    for batch in slices(batches):
        level = Level(batch, sizes, 1)
        found, first = level.alive(batch, len(sizes) - 1), level.words.first
        starts, copy = batch.column("starts"), batch.column("is_first")
        rows = {name: [] for name in ("n_words", "n_removed", "kept_text", "kept_sha256")}
        for i in range(batch.num_rows):
            text = (batch.column("text")[i].as_py() or "").encode()
            n = int(first[i + 1] - first[i])
            kept, lost = text.split(), 0
            if n >= width:
                if not copy[i].as_py():
                    kept, lost = [], n
                else:
                    hit = found[first[i] : first[i] + n - width + 1].copy()
                    own = starts[i].values
                    if own is not None and len(own):
                        own = own.to_numpy(zero_copy_only=False)
                        hit[own[own < len(hit)]] = False
                    if hit.any():
                        at = np.flatnonzero(hit)
                        edge = np.zeros(n + 1, np.int64)
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + width, -1)
                        stays = np.cumsum(edge[:-1]) == 0
                        lost = int(n - stays.sum())
                        kept = list(compress(kept, stays.tolist()))
            kept = b" ".join(kept)
            for name, value in zip(rows, (n, lost, kept.decode(), hashlib.sha256(kept).hexdigest())):
                rows[name].append(value)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), pa.array(rows["n_words"], pa.int64()), pa.array(rows["n_removed"], pa.int64()), pa.array(rows["kept_text"], pa.string()), pa.array(rows["kept_sha256"], pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"],
        )


def substring_dedup(docs: DataFrame, width: int = 20) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_words, n_removed, kept_text, kept_sha256, one row per row of docs."""
    if width < 2:
        raise ValueError("width must be 2 or more")
    sizes = lengths(width)
    rows = small_batches(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    body = F.coalesce("text", F.lit(""))
    # Where doc_ids repeat, the text's hash tells their rows apart; else it would only take space.
    repeated = rows.groupBy("doc_id").count().filter("count > 1").limit(1).count() > 0
    key = ["doc_id", "variant"] if repeated else ["doc_id"]
    kinds = ", ".join(f"{c} long" for c in key)

    def least(*more):
        """The least key of a group and what goes with it; primitive columns alone let Spark aggregate by hash."""
        if repeated:
            found = F.min(F.struct(*key, *more))
            return [found[c].alias(c) for c in (*key, *more)]
        return [F.min("doc_id").alias("doc_id"), *(F.min_by(c, "doc_id").alias(c) for c in more)]

    texts = rows.withColumn("variant", F.xxhash64(F.lit(3), body)) if repeated else rows
    firsts = texts.groupBy(F.xxhash64(body).alias("a"), F.xxhash64(F.lit(7), body).alias("b")).agg(*least()).select(*key, F.lit(None).cast("long").alias("h"), F.lit(True).alias("is_first"))
    marked = texts
    for level in range(len(sizes) - 1):
        parts = marked.mapInArrow(lambda it, level=level: _parts(it, sizes, level, key), f"h long, {kinds}, times int")
        known = parts.groupBy("h").agg(F.sum("times").alias("times"), *least()).filter("times = 1").select(*key, "h", F.lit(False).alias("is_first"))
        if level == 0:
            known = known.union(firsts)
        told = [F.collect_list("h").alias(f"single{level}")] + [F.max("is_first").alias("is_first")] * (level == 0)
        marked = marked.join(known.groupBy(*key).agg(*told), key, "left").withColumn("is_first", F.coalesce("is_first", F.lit(False)))
    full = marked.mapInArrow(lambda it: _full_windows(it, sizes, key), f"a long, b long, {kinds}, start int")
    starts = full.groupBy("a", "b").agg(*least("start")).groupBy(*key).agg(F.collect_list("start").alias("starts"))
    out = marked.join(starts, key, "left").mapInArrow(lambda it: _removed(it, sizes), RESULT)
    return out.withColumn("doc_id", F.expr(f"nullif(doc_id, {LAST}L)"))
