"""Token-id files: documents in ascending doc_id order, ids in patched frame-of-reference blocks.

A file: magic, blocks, document index (doc_id and number of ids, 64 bits each), block index, then a tail with the
counts. Documents are dealt out by ranges of (doc_id, hash of the text), so neither documents without an id nor one id on many rows
fall to one task; a task begins a new file where one has `file_ids` ids or `file_documents` documents, which bounds the indexes it holds. Files have names of their own in the
shared folder and are listed in a manifest that Spark commits, so files of lost or repeated attempts never count, and are deleted.

Cases: a null or empty text has the end id alone. An empty table makes no ids. Rows that repeat a doc_id are
documents of their own, in the order of their texts' hashes; null doc_ids come first. Other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import pfor
from .common import fresh_path, small_batches, sweep, written
from .text import slices
from .tokens import encoder

MAGIC = b"SLTOK01\n"
TAIL = struct.Struct("<QQQQ8s")  # documents, ids, blocks, first byte of the document index, magic
LEAST = -(1 << 63)  # stands for a null doc_id in files
MANIFEST = "part int, number int, path string, documents long, ids long"
DOCUMENT = np.dtype([("doc_id", "<i8"), ("ids", "<i8")])


class Writer:
    """Appends documents to a file; holds one short block of ids and the indexes."""

    def __init__(self, uri: str, percentile: float):
        self.percentile = percentile
        system, path = pafs.FileSystem.from_uri(uri)
        self.out = system.open_output_stream(path)
        self.out.write(MAGIC)
        self.at, self.rest = len(MAGIC), np.zeros(0, np.uint32)
        self.documents, self.index, self.ids, self.count = [], [], 0, 0

    def add(self, doc_ids: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> None:
        found = np.empty(len(doc_ids), DOCUMENT)
        found["doc_id"], found["ids"] = doc_ids, np.diff(bounds)
        self.documents.append(found)
        self.ids, self.count = self.ids + len(ids), self.count + len(found)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // pfor.BLOCK * pfor.BLOCK
        self.rest = ids[whole:]
        self._blocks(ids[:whole])

    def _blocks(self, ids: np.ndarray) -> None:
        data, index = pfor.encode(ids, self.percentile, self.at)
        self.out.write(data)
        self.at += len(data)
        self.index.append(index)

    def close(self) -> tuple[int, int]:
        self._blocks(self.rest)
        documents = np.concatenate([np.zeros(0, DOCUMENT), *self.documents])
        index = np.concatenate([np.zeros(0, pfor.INDEX), *self.index])
        self.out.write(documents.tobytes() + index.tobytes() + TAIL.pack(len(documents), self.ids, len(index), self.at, MAGIC))
        self.out.close()
        return len(documents), self.ids


def read_documents(uri: str, blocks: int = 2048):
    """(doc_id, ids before it in the file, ids) of each document of a file, some blocks in memory at a time."""
    system, path = pafs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as f:
        size = f.size()
        f.seek(size - TAIL.size)
        documents, total, n, at, magic = TAIL.unpack(f.read(TAIL.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token-id file")
        f.seek(at)
        docs = np.frombuffer(f.read(documents * DOCUMENT.itemsize), DOCUMENT)
        index = np.frombuffer(f.read(n * pfor.INDEX.itemsize), pfor.INDEX)
        held, nxt, start, read = np.zeros(0, np.uint32), 0, 0, 0
        for doc_id, length in zip(docs["doc_id"].tolist(), docs["ids"].tolist()):
            parts = [held]
            have = len(held)
            while have < length:
                some = index[nxt : nxt + blocks]
                stop = int(index["start"][nxt + blocks]) if nxt + blocks < n else at
                f.seek(int(some["start"][0]))
                values = pfor.decode(f.read(stop - int(some["start"][0])), some)[: total - read]
                nxt, read = nxt + len(some), read + len(values)
                parts.append(values)
                have += len(values)
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield doc_id, start, held[:length]
            held, start = held[length:], start + length


def write_token_files(
    docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, percentile: float = 0.98, file_ids: int = 1 << 28, file_documents: int = 1 << 20, batch_bytes: int = 4 << 20
) -> DataFrame:
    """Write the files; returns the manifest (part, number, path, documents, ids), itself a written table; files in the order of (part, number)."""
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "token-files")
    base_system, base = pafs.FileSystem.from_uri(folder)
    base_system.create_dir(base, recursive=True)

    def write(batches):
        part, number, out, name = TaskContext.get().partitionId(), 0, None, None
        coder = encoder(tokenizer, end_id)

        def finished():
            documents, ids = out.close()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([name]), pa.array([documents], pa.int64()), pa.array([ids], pa.int64())], ["part", "number", "path", "documents", "ids"])

        for batch in slices(batches, size=batch_bytes):
            if out is None:
                name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.tok"
                out = Writer(name, percentile)
            ids, bounds = coder.encode(batch.column("text"))
            out.add(batch.column("doc_id").to_numpy(zero_copy_only=False), ids, bounds)
            if out.ids >= file_ids or out.count >= file_documents:
                yield finished()
                out, number = None, number + 1
        if out is not None:
            yield finished()

    rows = small_batches(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    manifest = written(dealt.mapInArrow(write, MANIFEST), "token-manifest")
    sweep(folder, manifest)
    return manifest


def read_token_files(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked, ids of every document of the files in a manifest."""
    before = F.sum("ids").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("path", F.coalesce(before, F.lit(0)).alias("before"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids]
    types = [pa.int64()] * 4 + [pa.list_(pa.int64())]

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
                rows, held = [], 0
                for doc_id, start, ids in read_documents(path):
                    row = [None if doc_id == LEAST else doc_id, base + start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())]
                    rows.append(row + [ids.astype(np.int64)] * with_ids)
                    held += len(ids) if with_ids else 1
                    if held > 1 << 20 or len(rows) >= 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    spark = manifest.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(n).mapInArrow(read, schema)
