"""PLINK files: .bim and .fam as delimited text, .bed as byte ranges unpacked in the tasks; and a writer for .bed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .vcf import Vcf, joined_parts

BIM = "chrom string, snpid string, cm double, pos long, allele1 string, allele2 string"
FAM = "fid string, iid string, father string, mother string, sex string, pheno string"
MAGIC = bytes([0x6C, 0x1B, 0x01])  # fixed value: variant-major .bed
CODES = np.array([0, -1, 1, 2], np.int8)  # fixed values: two-bit code to alternative alleles, -1 is missing


def unpack(raw: np.ndarray, n: int) -> np.ndarray:
    """Rows of bytes, four samples each from the low bits up, to alternative alleles of n samples."""
    codes = (raw[:, :, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3
    return CODES[codes.reshape(len(raw), -1)[:, :n]]


def pack(alleles: np.ndarray) -> bytes:
    """Alternative alleles (-1: missing), one row per variant, as the body of a .bed file."""
    code = np.array([0, 2, 3, 1], np.uint8)[alleles]  # indices 0, 1, 2 and -1
    code = np.pad(code, ((0, 0), (0, -code.shape[1] % 4))).reshape(len(code), -1, 4)
    return (code << np.array([0, 2, 4, 6], np.uint8)).sum(axis=2).astype(np.uint8).tobytes()


def write_plink(variants: DataFrame, samples: DataFrame, genotypes: DataFrame, prefix: str) -> None:
    """prefix.bed, .bim and .fam of biallelic variants; genotypes (variant_idx, sample_idx, gt), gt null or absent: missing. variant_idx and sample_idx count from 1 without gaps.

    A variant's row of the .bed is made in the task that holds its genotypes; parts are put together as streams.
    """
    spark = genotypes.sparkSession
    n = samples.count()
    width = -(-n // 4)
    listed = genotypes.filter("gt is not null").groupBy("variant_idx").agg(F.collect_list(F.struct("sample_idx", "gt")).alias("calls"))
    listed = variants.select("variant_idx").join(listed, "variant_idx", "left").repartitionByRange("variant_idx").sortWithinPartitions("variant_idx")

    def rows(batches):
        for pdf in batches:
            out = np.full((len(pdf), n), -1, np.int64)
            for row, calls in zip(out, pdf["calls"]):
                for call in calls if calls is not None else ():
                    row[call["sample_idx"] - 1] = call["gt"]
            data = pack(out)
            yield pd.DataFrame({"variant_idx": pdf["variant_idx"], "row": [data[at : at + width] for at in range(0, len(data), width)]})

    def text(df: DataFrame, by: str, path: str, sep: str) -> None:
        fields = [F.col(c).cast("string") for c in df.columns if c != by]
        df.repartitionByRange(by).sortWithinPartitions(by).select(F.concat_ws(sep, *fields).alias("line")).write.mode("overwrite").text(f"{path}.parts")
        joined_parts(spark, f"{path}.parts", path)

    text(variants.select("variant_idx", "chrom", F.coalesce(F.get("ids", F.lit(0)), F.lit(".")).alias("snpid"), F.lit("0").alias("cm"), "pos", "ref", F.get("alts", F.lit(0)).alias("alt")), "variant_idx", f"{prefix}.bim", "\t")
    text(samples.select("sample_idx", "sample_id", F.col("sample_id").alias("iid"), *[F.lit(v).alias(f"c{i}") for i, v in enumerate(("0", "0", "0", "-9"))]), "sample_idx", f"{prefix}.fam", " ")
    # Rows have one length, so a table sorted by variant holds the body in order; the driver copies a part at a time.
    made = listed.mapInPandas(rows, "variant_idx int, row binary")
    made.write.mode("overwrite").parquet(f"{prefix}.bed.parts")
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(f"{prefix}.bed") if "://" in prefix else (fs.LocalFileSystem(), f"{prefix}.bed")
    with system.open_output_stream(path, compression=None) as f:
        f.write(MAGIC)
        for row in spark.read.parquet(f"{prefix}.bed.parts").orderBy("variant_idx").toLocalIterator():
            f.write(bytes(row["row"]))
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{prefix}.bed.parts")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def vcf_to_plink(spark: SparkSession, path: str, prefix: str) -> None:
    """The hard calls of a VCF file as PLINK files."""
    found = Vcf(spark, path)
    write_plink(found.variants, found.samples(), found.genotypes(), prefix)


def read_plink(spark: SparkSession, prefix: str, variants_per_task: int = 4096) -> tuple[DataFrame, DataFrame, DataFrame]:
    """variants, samples and genotypes of prefix.bed, .bim and .fam. REF is allele1, ALT is allele2."""
    bim = spark.read.csv(f"{prefix}.bim", schema=BIM, sep="\t")
    order = F.monotonically_increasing_id()
    variants = bim.withColumn("_at", order).withColumn("variant_idx", F.row_number().over(Window.orderBy("_at"))).select(
        "variant_idx", "chrom", "pos", F.array("snpid").alias("ids"), F.col("allele1").alias("ref"), F.array("allele2").alias("alts")
    )
    fam = spark.read.text(f"{prefix}.fam").select(F.split(F.trim("value"), r"\s+").alias("f"), order.alias("_at"))
    samples = fam.withColumn("sample_idx", F.row_number().over(Window.orderBy("_at"))).select("sample_idx", F.col("f")[1].alias("sample_id"))
    n, m = samples.count(), variants.count()
    width = -(-n // 4)

    def read(batches):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(f"{prefix}.bed") if "://" in prefix else (fs.LocalFileSystem(), f"{prefix}.bed")
        with system.open_input_file(path) as f:
            if f.read(3) != MAGIC:
                raise ValueError(f"{prefix}.bed is no variant-major .bed file")
            for batch in batches:
                for block in batch["id"].tolist():
                    lo, hi = block * variants_per_task, min(m, (block + 1) * variants_per_task)
                    f.seek(3 + lo * width)
                    found = unpack(np.frombuffer(f.read((hi - lo) * width), np.uint8).reshape(hi - lo, width), n)
                    gt = found.reshape(-1).astype(object)
                    gt[gt == -1] = None
                    yield pd.DataFrame({"variant_idx": np.repeat(np.arange(lo, hi) + 1, n), "sample_idx": np.tile(np.arange(n) + 1, hi - lo), "gt": gt})

    blocks = -(-m // variants_per_task)
    genotypes = spark.range(0, blocks, 1, max(1, blocks)).mapInPandas(read, "variant_idx int, sample_idx int, gt int")
    return variants, samples, genotypes
