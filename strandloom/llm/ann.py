"""Nearest neighbours by cosine: cross-polytope hashing with multiprobe tables and exact reranking.

A table rotates unit vectors by three rounds of random signs and fast Hadamard transforms; a hash is the signed axis nearest to
the rotated vector. A table's bucket is named by several hashes of rotations of their own, the last of which may look at a part of
the axes only, so that there are about one bucket for `bucket_rows` rows: buckets grow in number with the rows, not in size. Every
vector is indexed in every table. A query looks into the buckets of each table that it is nearest to, `reach` times the square
root of their number; so the share of rows that are compared to a query falls with the square root of the rows.

What is shuffled is one row per vector and table, and one per query and part with the numbers of the buckets to look at there. A
bucket beyond `block` rows is dealt to several parts by hash of vec_id, and queries go to each, so buckets have no cap and one
vector (or a cluster of near copies) that fills a third of a table does no harm. A task holds one part at a time and streams the
queries past it; it returns the k best of a part for each query, so rows grow with the queries, never with pairs. Scores are
double-precision cosines of the original vectors, summed in one order whatever the batch, so equal vectors tie exactly.

A query for which fewer than k rows were found is compared to all rows, in parts; so k rows come back where the table has them.

Cases: vectors that are null, zero, or hold null or non-finite components take no part. Vectors of different lengths compare as if
filled up with zeros. Rows that repeat a vec_id are one candidate (its best); a query never meets rows of its own vec_id.
Ties go to the smaller vec_id. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .text import mix

DEALT = "part int, is_query boolean, body binary, keys binary"
FOUND = "query_id long, vec_id long, score double"
HOT = 20_000  # most buckets that are dealt to several parts: a bound on what the driver hands out


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Usable rows of a list column, as doubles scaled by powers of two, and their places."""
    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(column)), length)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
    out = np.zeros((len(column), dim))
    bad = ~np.isfinite(flat)
    out[row[~bad], place[~bad]] = flat[~bad]
    top = np.abs(out).max(axis=1, initial=0)
    ok = (top > 0) & (np.bincount(row[bad], minlength=len(column)) == 0)
    out = out[ok]
    return np.ldexp(out, -np.frexp(top[ok])[1][:, None]), np.flatnonzero(ok)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row, of a power of two components."""
    rows, dim = x.shape
    half = 1
    while half < dim:
        pairs = x.reshape(rows, dim // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(rows, dim)
        half *= 2
    return x / np.sqrt(dim)


class Polytopes:
    """The pseudo-rotations of all tables, the same for the same parameters everywhere; a table has 2 ** bits buckets."""

    def __init__(self, dim: int, tables: int, bits: int, seed: int):
        self.dim = 1 << max(1, (dim - 1).bit_length())
        most = self.dim.bit_length()  # a hash of all axes has one bit for the sign and the others for the axis
        self.widths = [most] * (bits // most) + [bits % most] * (bits % most > 0)
        self.bits, self.tables = bits, tables
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, len(self.widths), 3, self.dim))

    def rotated(self, x: np.ndarray, table: int, number: int) -> np.ndarray:
        """The axes that a hash looks at."""
        if x.shape[1] < self.dim:
            x = np.pad(x, ((0, 0), (0, self.dim - x.shape[1])))
        for signs in self.signs[table, number]:
            x = hadamard(x * signs)
        return x[:, : 1 << self.widths[number] - 1]

    def buckets(self, x: np.ndarray, table: int) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for number, width in enumerate(self.widths):
            y = self.rotated(x, table, number)
            axis = np.abs(y).argmax(axis=1)
            out = (out << width) + 2 * axis + (y[np.arange(len(y)), axis] < 0)
        return out + (table << self.bits)

    def probes(self, x: np.ndarray, table: int, n: int) -> np.ndarray:
        """The n buckets of a table nearest to each row: by the squared shortfall to the nearest axes, summed over the hashes."""
        bucket, cost = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        for number, width in enumerate(self.widths):
            y = self.rotated(x, table, number)
            near = np.stack([y, -y], axis=2).reshape(len(x), -1)  # value at 2 * axis + (negative side)
            short = (near.max(axis=1, keepdims=True) - near) ** 2
            bucket = ((bucket << width)[:, :, None] + np.arange(1 << width)).reshape(len(x), -1)
            cost = (cost[:, :, None] + short[:, None, :]).reshape(len(x), -1)
            if cost.shape[1] > n:
                keep = np.argpartition(cost, n - 1, axis=1)[:, :n]
                bucket, cost = np.take_along_axis(bucket, keep, axis=1), np.take_along_axis(cost, keep, axis=1)
        return bucket + (table << self.bits)


def bits_for(rows: int, bucket_rows: int) -> int:
    """Bits of a bucket's name: about one bucket for bucket_rows rows, two at least."""
    return max(1, (rows // bucket_rows).bit_length() - 1)


class Part:
    """The rows of one part by bucket; each different row is held once, in however many tables it is."""

    def __init__(self, keys: list[bytes], bodies: list[bytes], dim: int):
        key = np.frombuffer(b"".join(keys), np.int64)
        coded = pa.array(bodies, pa.large_binary()).dictionary_encode()
        by = np.argsort(key, kind="stable")
        self.key, self.code = key[by], coded.indices.to_numpy(zero_copy_only=False)[by]
        self.ids, self.rows = unpacked(coded.dictionary.to_pylist(), dim)
        self.unit = self.rows / np.sqrt((self.rows * self.rows).sum(axis=1, keepdims=True))
        self.repeats = len(np.unique(self.ids)) < len(self.ids)

    def nearest(self, query_id: int, query: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(vec_id, score) of the k best rows of another id in the given buckets, ties to the smaller id."""
        lo, hi = np.searchsorted(self.key, keys), np.searchsorted(self.key, keys, "right")
        lo, count = lo[hi > lo], (hi - lo)[hi > lo]
        at = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
        some = np.unique(self.code[at])
        some = some[self.ids[some] != query_id]
        size = np.sqrt((query * query).sum())
        if len(some) > k and not self.repeats:
            rough = self.unit[some] @ (query / size)
            least = -np.partition(-rough, k - 1)[k - 1]
            some = some[rough >= least - 1e-9]
        rows, ids = self.rows[some], self.ids[some]
        score = (query * rows).sum(axis=1) / (size * np.sqrt((rows * rows).sum(axis=1)))
        by = np.lexsort((ids, -score))
        if self.repeats:
            by = by[np.sort(np.unique(ids[by], return_index=True)[1])]
        return ids[by[:k]], score[by[:k]]


def packed(ids: np.ndarray, x: np.ndarray) -> list[bytes]:
    """Of each row its id and vector as bytes; in single precision where that loses nothing."""
    single = x.astype(np.float32)
    x = single if (single == x).all() else x
    return [i + v.tobytes() for i, v in zip((i.tobytes() for i in ids.astype(np.int64)), x)]


def unpacked(bodies: list[bytes], dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.array([int.from_bytes(b[:8], "little", signed=True) for b in bodies], np.int64)
    return ids, np.array([np.frombuffer(b, np.float32 if len(b) == 8 + 4 * dim else np.float64, offset=8) for b in bodies], np.float64).reshape(len(bodies), dim)


def _searched(batches, k, dim):
    """Rows sorted by (part, is_query): the rows of a part come before the queries that look into it."""
    part, keys, bodies, made = None, [], [], None
    for batch in batches:
        found = [[], [], []]
        for number, is_query, body, key in zip(*(batch.column(c).to_pylist() for c in ("part", "is_query", "body", "keys"))):
            if number != part:
                part, keys, bodies, made = number, [], [], None
            if not is_query:
                keys.append(key)
                bodies.append(body)
            elif keys:
                made = made or Part(keys, bodies, dim)
                (query_id,), (query,) = unpacked([body], dim)
                ids, score = made.nearest(query_id, query, np.frombuffer(key, np.int64), k)
                for column, values in zip(found, (np.full(len(ids), query_id), ids, score)):
                    column.append(values)
        if found[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in found], ["query_id", "vec_id", "score"])


class Dealer:
    """Which part a row of a bucket is in, and which parts a query must see for a bucket."""

    def __init__(self, parts: int, hot: list[tuple[int, int]]):
        self.parts = parts
        self.keys = np.array([key for key, _ in hot], np.int64)
        self.shares = np.array([shares for _, shares in hot], np.int64)

    def shares_of(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            known = self.keys[at] == keys
            out[known] = self.shares[at[known]]
        return out

    def part(self, keys: np.ndarray, share: np.ndarray) -> np.ndarray:
        return (mix(mix(keys.astype(np.uint64)) + share.astype(np.uint64)) % np.uint64(self.parts)).astype(np.int64)

    def of_rows(self, keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return self.part(keys, mix(ids.astype(np.uint64)) % self.shares_of(keys).astype(np.uint64))

    def of_queries(self, query: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, part, key) of each part that a (query, key) pair must see, in that order; a part once for a pair."""
        shares = self.shares_of(keys)
        query, keys = np.repeat(query, shares), np.repeat(keys, shares)
        part = self.part(keys, np.arange(len(keys)) - np.repeat(np.cumsum(shares) - shares, shares))
        by = np.lexsort((keys, part, query))
        query, part, keys = query[by], part[by], keys[by]
        new = np.ones(len(by), bool)
        new[1:] = (query[1:] != query[:-1]) | (part[1:] != part[:-1]) | (keys[1:] != keys[:-1])
        return query[new], part[new], keys[new]


def _rows(batches, dim, names, dealer):
    """names(x): the buckets of each row, one column per table."""
    for batch in batches:
        x, at = matrix(batch.column("embedding"), dim)
        ids = batch.column("vec_id").to_numpy(zero_copy_only=False)[at]
        bodies = pa.array(packed(ids, x), pa.binary())
        for keys in names(x).T:
            keys = np.ascontiguousarray(keys)
            blobs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8), len(keys), [None, pa.py_buffer(keys)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(dealer.of_rows(keys, ids), pa.int32()), pa.array(np.zeros(len(keys), bool)), bodies, blobs], ["part", "is_query", "body", "keys"])


def _queries(batches, dim, names, dealer, step=32):
    for batch in batches:
        for lo in range(0, batch.num_rows, step):
            some = batch.slice(lo, step)
            x, at = matrix(some.column("embedding"), dim)
            ids = some.column("vec_id").to_numpy(zero_copy_only=False)[at]
            bodies, keys = packed(ids, x), names(x)
            query, part, key = dealer.of_queries(np.repeat(np.arange(len(x)), keys.shape[1]), keys.reshape(-1))
            first = np.flatnonzero(np.append(True, (query[1:] != query[:-1]) | (part[1:] != part[:-1]))) if len(query) else np.zeros(0, np.int64)
            blobs = [key[a:b].tobytes() for a, b in zip(first, np.append(first[1:], len(key)))]
            columns = [pa.array(part[first], pa.int32()), pa.array(np.ones(len(first), bool)), pa.array([bodies[q] for q in query[first]], pa.binary()), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "is_query", "body", "keys"])


def nearest_neighbours(vectors: DataFrame, is_query, k: int = 5, tables: int = 3, reach: float = 10.0, bucket_rows: int = 3, seed: int = 7, block: int = 4096, part_rows: int = 50_000) -> DataFrame:
    """vectors (vec_id, embedding, ...) -> query_id, rank, vec_id, score for the rows where the condition is_query holds."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("is_query")).filter("vec_id is not null")
    dim, n = rows.agg(F.max(F.size("embedding")), F.count(F.lit(1))).first()
    dim = max(1, dim or 1)
    rotations = Polytopes(dim, tables, bits_for(n, bucket_rows), seed)
    probes = min(1 << rotations.bits, ceil(reach * sqrt(1 << rotations.bits)))
    asked = rows.filter("is_query")
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")

    def index(x):
        return np.stack([rotations.buckets(x, table) for table in range(tables)], axis=1)

    def looked_up(x):
        return np.concatenate([rotations.probes(x, table, probes) for table in range(tables)], axis=1)

    def bucket_keys(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(index(matrix(batch.column("embedding"), dim)[0]).reshape(-1))], ["key"])

    def searched(of_rows, queries, of_queries, dealer):
        dealt = rows.mapInArrow(lambda it: _rows(it, dim, of_rows, dealer), DEALT).unionByName(queries.mapInArrow(lambda it: _queries(it, dim, of_queries, dealer), DEALT))
        found = dealt.repartition("part").sortWithinPartitions("part", "is_query").mapInArrow(lambda it: _searched(it, k, dim), FOUND)
        one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return one.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    least = max(block, n * tables // HOT)
    sizes = rows.select("embedding").mapInArrow(bucket_keys, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    hot = sorted((r["key"], -(-r["n"] // block)) for r in sizes.filter(F.col("n") > least).collect())  # HOT rows at most
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * tables // part_rows))
    first = written(searched(index, asked, looked_up, Dealer(parts, hot)), "neighbours")
    enough = first.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = asked.join(enough, "vec_id", "left_anti")
    if short.limit(1).count() == 0:
        return first
    # One bucket of all rows, in as many parts as hold them.
    parts = max(1, -(-n // part_rows))
    one = Dealer(parts, [(0, parts * 64)])
    rest = searched(lambda x: np.zeros((len(x), 1), np.int64), short, lambda x: np.zeros((len(x), 1), np.int64), one)
    return first.join(enough.select(F.col("vec_id").alias("query_id")), "query_id", "left_semi").select("query_id", "rank", "vec_id", "score").union(rest)
