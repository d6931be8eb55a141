"""BGEN (version 1.2, layout 2; zlib or no compression) as a Python data source, a partition per run of variants."""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "line int, chrom string, pos long, ids array<string>, ref string, alts array<string>, phased boolean, sample_idx int, ds float, a1 int, a2 int"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def _at(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _open(path: str):
    system, name = _at(path)
    return system.open_input_file(name)


def _number(f, kind: str) -> int:
    return struct.unpack("<" + kind, f.read(struct.calcsize("<" + kind)))[0]


def header(f) -> dict:
    f.seek(0)
    offset, length = _number(f, "I"), _number(f, "I")
    variants, samples, magic = _number(f, "I"), _number(f, "I"), f.read(4)
    if magic not in (b"bgen", b"\0\0\0\0"):
        raise ValueError("not a BGEN file")
    f.seek(length)  # the flags end the header block, which starts at byte 4
    flags = _number(f, "I")
    if flags >> 2 & 15 != 2 or flags & 3 == 2:
        raise ValueError("only layout 2 with zlib or no compression is read")
    names = []
    if flags >> 31:
        f.read(8)
        names = [f.read(_number(f, "H")).decode() for _ in range(samples)]
    return {"first": offset + 4, "variants": variants, "samples": samples, "zlib": flags & 3 == 1, "names": names}


def sample_names(path: str) -> list[str]:
    """Names in the file's order: of a .sample file beside it, else its own, else sample_1 and so on."""
    with _open(path) as f:
        info = header(f)
    system, beside = _at(path.removesuffix(".bgen") + ".sample")
    if system.get_file_info(beside).is_file:
        with system.open_input_file(beside) as f:
            lines = [line.split() for line in f.read().decode().splitlines() if line.strip()]
        column = 1 if lines and {"ID_1", "ID_2"} <= set(lines[0]) else 0  # ID_1 is the family then
        names = [line[column] for line in lines[2:]]  # behind the line of column names and that of their kinds
        if len(names) != info["samples"]:
            raise ValueError(f"{beside} names {len(names)} samples, {path} has {info['samples']}")
        return names
    return info["names"] or [f"sample_{s}" for s in range(1, info["samples"] + 1)]


def variant(f, compressed: bool, skip: bool = False):
    """The variant at the file's place: names and alleles, and its probability block unless skipped."""
    names = [f.read(_number(f, "H")).decode() for _ in range(3)]
    pos, k = _number(f, "I"), _number(f, "H")
    alleles = [f.read(_number(f, "I")).decode() for _ in range(k)]
    size = _number(f, "I")
    if skip:
        f.seek(f.tell() + size)
        return None
    data = f.read(size)
    return names, pos, alleles, zlib.decompress(data[4:]) if compressed else data


def probabilities(block: bytes) -> tuple[bool, np.ndarray, np.ndarray]:
    """(phased, missing, probabilities as rows of stored values) of a biallelic diploid variant."""
    n, k, low, high = struct.unpack("<IHBB", block[:8])
    if k != 2 or (low, high) != (2, 2):
        raise ValueError("only biallelic diploid variants are read")
    missing = np.frombuffer(block, np.uint8, n, 8) >> 7 == 1
    phased, bits = block[8 + n], block[9 + n]
    raw = np.unpackbits(np.frombuffer(block, np.uint8, offset=10 + n), bitorder="little")[: 2 * n * bits].reshape(2 * n, bits)
    value = raw @ (2.0 ** np.arange(bits)) / (2.0**bits - 1)
    return bool(phased), missing, value.reshape(n, 2)


def rows(f, info: dict, number: int, first: int = 0):
    """An Arrow batch of long-form rows for each of the next `number` variants; line is the variant's place in the file, ds counts ALT alleles, a1 and a2 are set where a variant is phased."""
    for line in range(first, first + number):
        (snp, rs, chrom), pos, alleles, block = variant(f, info["zlib"])
        if len(alleles) != 2:
            raise ValueError(f"variant at {pos} isn't biallelic")
        phased, missing, p = probabilities(block)
        # Phased: probability of REF on each strand. Unphased: of REF/REF and of REF/ALT.
        ds = (2 - p.sum(axis=1)) if phased else 2 - 2 * p[:, 0] - p[:, 1]
        n = len(p)
        same = lambda value, kind: pa.repeat(pa.scalar(value, kind), n)
        sides = [pa.array((1 - p[:, side] >= 0.5).astype(np.int32), mask=missing) if phased else pa.nulls(n, pa.int32()) for side in (0, 1)]
        yield pa.RecordBatch.from_arrays(
            [same(line, pa.int32()), same(chrom, pa.string()), same(pos, pa.int64()), same([x for x in (rs or snp,) if x], pa.list_(pa.string())), same(alleles[0], pa.string()),
             same(alleles[1:], pa.list_(pa.string())), same(phased, pa.bool_()), pa.array(np.arange(1, n + 1, dtype=np.int32)), pa.array(ds.astype(np.float32), mask=missing), *sides],
            NAMES,
        )


class Part(InputPartition):
    def __init__(self, at: int, number: int, first: int):
        self.at, self.number, self.first = at, number, first


def indexed_places(path: str) -> list[int] | None:
    """Where the variants begin, by a .bgi index beside a local file; None where there is none."""
    if "://" in path or not os.path.exists(path + ".bgi"):
        return None
    import sqlite3

    with sqlite3.connect(f"file:{path}.bgi?mode=ro", uri=True) as db:
        return [at for at, in db.execute("SELECT file_start_position FROM Variant ORDER BY file_start_position")]


class BgenReader(DataSourceReader):
    def __init__(self, path: str, per_part: int):
        self.path, self.per_part = path, per_part

    def partitions(self):
        """By the index where there is one; else by a walk over the variants' headers."""
        places = indexed_places(self.path)
        with _open(self.path) as f:
            info, out = header(f), []
            if places is not None and len(places) != info["variants"]:
                raise ValueError(f"{self.path}.bgi lists {len(places)} variants, the file has {info['variants']}")
            f.seek(info["first"])
            for i in range(info["variants"]):
                if i % self.per_part == 0:
                    out.append(Part(places[i] if places is not None else f.tell(), min(self.per_part, info["variants"] - i), i))
                if places is None:
                    variant(f, info["zlib"], skip=True)
        return out

    def read(self, partition):
        with _open(self.path) as f:
            info = header(f)
            f.seek(partition.at)
            yield from rows(f, info, partition.number, partition.first)


class BgenSource(DataSource):
    """spark.dataSource.register(BgenSource); spark.read.format("bgen").load(path)"""

    @classmethod
    def name(cls):
        return "bgen"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return BgenReader(self.options["path"], int(self.options.get("variants_per_part", 1024)))


def write_bgen(path: str, variants: list[tuple], bits: int = 8, names: list[str] | None = None) -> None:
    """variants: (chrom, pos, id, ref, alt, phased, n x 2 probabilities with NaN rows where missing); a small writer for exchange and tests."""
    n = len(variants[0][6])
    with open(path, "wb") as f:
        listed = b"".join(struct.pack("<H", len(name.encode())) + name.encode() for name in names or [])
        samples = struct.pack("<II", 8 + len(listed), n) + listed if names else b""
        f.write(struct.pack("<IIII4sI", 20 + len(samples), 20, len(variants), n, b"bgen", 1 | 2 << 2 | bool(names) << 31) + samples)
        for chrom, pos, name, ref, alt, phased, p in variants:
            p = np.asarray(p, float)
            lost = np.isnan(p).any(axis=1)
            stored = np.rint(np.nan_to_num(p) * (2**bits - 1)).astype(np.uint32).reshape(-1)
            packed = np.packbits(((stored[:, None] >> np.arange(bits)) & 1).astype(np.uint8).reshape(-1), bitorder="little").tobytes()
            block = struct.pack("<IHBB", n, 2, 2, 2) + (2 | lost.astype(np.uint8) << 7).astype(np.uint8).tobytes() + bytes([phased, bits]) + packed
            data = zlib.compress(block)
            for text in (name, name, chrom):
                f.write(struct.pack("<H", len(text)) + text.encode())
            f.write(struct.pack("<IH", pos, 2))
            for allele in (ref, alt):
                f.write(struct.pack("<I", len(allele)) + allele.encode())
            f.write(struct.pack("<II", len(data) + 4, len(block)) + data)
