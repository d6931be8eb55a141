"""WARC archives without repeated payloads.

Headers (page_id, url, SHA-256 digest and length) of payloads of `minimum` bytes or more are shuffled by digest, payloads are not. Of equal
ones the page with the least page_id is written as a response, the others as revisit records that refer to it (profile
identical-payload-digest), which need no payload. Where a page's payload lies, a bitmap of the revisits tells which pages are surely
responses; those are written from there. Only pages that share a place of the bitmap with a revisit are shuffled, with their payloads, to be
looked up: about one in a hundred while revisits are fewer than a hundredth of its 2 ** 24 places, more beyond, at worst all.
Digests that many pages share are aggregated before the shuffle and joined by a join that Spark splits.

Record ids follow from page ids, so a revisit names its original without another look-up. Records are gzip members of their
own; a task starts a new archive beyond `file_bytes`. Archives get names of their own in the shared folder, and the
manifest, which Spark commits, lists those that count; files of lost or repeated attempts are never read, and are deleted.

Reading checks every response's length and digest, and revisits are resolved by joining them to the responses that
they refer to.

Cases: a null payload is empty; payloads below `minimum` are always responses, and aren't shuffled. Rows that repeat a page_id with the
same payload are all responses if the id is the least of its group. A null page_id is written without an id and comes back null; it is never an original that others refer to.
Other columns are ignored. An empty table makes no archive.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, fresh_path, may_be_in, place, remove, small_batches, sweep, text_or_empty, written

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ORDER = ["page_id", "url", "digest", "size", "original", "original_url"]
LEAST = -(1 << 63)  # stands for a null page_id in a look-up
MANIFEST = "path string, records long, bytes long"
RECORD = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, url string"
RECORD_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
RECORD_NAMES = ["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "url"]


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def header_value(value: str | None) -> str:
    """A header's value on one line: control characters and spaces as percent codes."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value or "")


def record(page_id, url, payload: bytes | None, size: int, digest: str, original, original_url, date: str) -> bytes:
    """A response with its payload, or without one a revisit of the original."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    revisit = payload is None
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date),
        ("WARC-Target-URI", header_value(url)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(original)), ("WARC-Refers-To-Target-URI", header_value(original_url)), ("X-Refers-To-Page-ID", str(original))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress(data) + made.flush()


def read_records(uri: str, chunk: int = 1 << 20):
    """(fields, block) of each record of an archive, one in memory at a time."""
    system, path = pafs.FileSystem.from_uri(uri)
    with system.open_input_stream(path, compression=None) as f:
        raw = f.read(chunk)
        while raw:
            inflate, parts = zlib.decompressobj(31), []
            while not inflate.eof:
                if not raw:
                    raw = f.read(chunk)
                    if not raw:
                        raise ValueError(f"{uri} ends within a record")
                parts.append(inflate.decompress(raw))
                raw = inflate.unused_data if inflate.eof else b""
            raw = raw or f.read(chunk)
            head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            yield fields, rest[: int(fields["Content-Length"])]


def _in_bitmap(batch: pa.RecordBatch, places: np.ndarray) -> pa.Array:
    """Of each row whether it has a place, and that is one of the bitmap's."""
    at = batch.column("place")
    found = may_be_in(places, pc.fill_null(at, 0).to_numpy(zero_copy_only=False))
    return pc.and_(pc.is_valid(at), pa.array(found))


def _asked(batches, places):
    for batch in batches:
        yield batch.filter(_in_bitmap(batch, places))


def write_warc(pages: DataFrame, folder: str | None = None, minimum: int = 100, file_bytes: int = 64 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """pages (page_id, url, html, ...) -> the manifest (path, records, bytes) of the archives, a written table."""
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    system, base = pafs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    body = text_or_empty("html")
    rows = small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html"), F.sha2(body.cast("binary"), 256).alias("digest"), F.octet_length(body).cast("long").alias("size"))
    headers = rows.filter(F.col("size") >= minimum).select("page_id", "url", "digest", "size")
    originals = headers.groupBy("digest").agg(F.min("page_id").alias("original"), F.min_by("url", "page_id").alias("original_url"), F.count(F.lit(1)).alias("pages")).filter("pages > 1 and original is not null").drop("pages")
    revisits = written(headers.join(originals.hint("merge"), "digest").filter("page_id is null or page_id <> original").select(*ORDER), "warc-revisits")
    key = F.xxhash64("page_id", "digest")
    places = bitmap(revisits.select(key.alias("key")), "key")
    rows = rows.withColumn("place", F.when(F.col("size") >= minimum, place(key)))
    known = revisits.select(F.coalesce("page_id", F.lit(LEAST)).alias("page"), "digest").distinct()
    some = rows.mapInArrow(lambda it: _asked(it, places), rows.schema).withColumn("page", F.coalesce("page_id", F.lit(LEAST))).join(known, ["page", "digest"], "left_anti")
    plain = [F.lit(None).cast("long").alias("original"), F.lit(None).cast("string").alias("original_url")]
    responses = rows.unionByName(some.drop("page").withColumn("place", F.lit(None).cast("int"))).select("*", *plain)

    def write(batches):
        out = name = None
        records = size = 0

        def finished():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])

        for batch in batches:
            batch = batch.filter(pc.invert(_in_bitmap(batch, places)))  # those come from the look-up instead
            for page_id, url, html, digest, size_, original, original_url in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "size", "original", "original_url"))):
                payload = html.as_py()
                if out is None:
                    name = f"{folder}/archive-{uuid.uuid4().hex}.warc.gz"
                    fs, path = pafs.FileSystem.from_uri(name)
                    out, records, size = fs.open_output_stream(path, compression=None), 0, 0
                data = member(record(page_id.as_py(), url.as_py(), None if payload is None else payload.encode(), size_.as_py(), digest.as_py(), original.as_py(), original_url.as_py(), date))
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= file_bytes:
                    yield finished()
                    out = None
        if out is not None:
            yield finished()

    records_ = responses.unionByName(revisits.withColumns({"html": F.lit(None).cast("string"), "place": F.lit(None).cast("int")}))
    manifest = written(records_.mapInArrow(write, MANIFEST), "warc-manifest")
    remove(revisits)
    sweep(folder, manifest)
    return manifest


def read_warc(manifest: DataFrame) -> DataFrame:
    """One row per record of the archives; a revisit's payload_bytes is null until it is resolved."""
    def read(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                for fields, block in read_records(path):
                    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].partition(":")[2]
                    head, _, payload = block.partition(b"\r\n\r\n")
                    length = None
                    if kind == "response":
                        length = len(payload)
                        if hashlib.sha256(payload).hexdigest() != digest or b"Content-Length: %d" % length not in head.split(b"\r\n"):
                            raise ValueError(f"{path}: {fields['WARC-Record-ID']} is damaged")
                    ids = [int(fields[k]) if k in fields else None for k in ("X-Page-ID", "X-Refers-To-Page-ID")]
                    rows.append((ids[0], kind, length, digest, ids[1], fields["WARC-Target-URI"]))
                    if len(rows) >= 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), RECORD_TYPES)], RECORD_NAMES)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), RECORD_TYPES)], RECORD_NAMES)

    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("path").repartition(n).mapInArrow(read, RECORD)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """records with each revisit's payload_bytes from the response it refers to; a revisit without one of the same digest keeps null."""
    originals = records.filter("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("original_bytes"))
    # Spark takes what is read from a short manifest for small; the hint keeps originals from being broadcast.
    joined = records.join(originals.hint("merge"), ["refers_to", "payload_digest"], "left")
    return joined.select("page_id", F.coalesce("payload_bytes", "original_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "url")
