"""Tables on disk: compressed panels, compact phase results, populations and CSV reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PANEL = ("variants", "samples", "windows", "unique_all", "unique_typed", "frequency", "typed")
FLANKED = ("padded", "unique_padded")  # only with overlapping windows
COMPACT = ".loom"  # what the name of a compact phase result ends in


def save_panel(tables: dict[str, DataFrame], path: str) -> None:
    """Haplotype tables are dealt out by window, which is what searches and imputation join by."""
    for name in (*PANEL, *(n for n in FLANKED if n in tables)):
        table = tables[name].repartition("window") if name.startswith("unique") else tables[name]
        table.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")


def load_panel(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    if path.endswith((".vcf", ".vcf.gz", ".bgen")):
        raise ValueError(f"{path} is a raw panel; compress it first with compress_haplotypes")
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{FLANKED[0]}")
    flanked = FLANKED if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) else ()
    return {name: spark.read.parquet(f"{path}/{name}") for name in (*PANEL, *flanked)}


def save_phase(segments: DataFrame, samples: DataFrame, path: str) -> None:
    """The compact result: segments and sample ids; genotypes are decoded on demand."""
    segments.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/segments")
    samples.write.mode("overwrite").parquet(f"{path}/samples")


def load_phase(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/segments"), spark.read.parquet(f"{path}/samples")


def read_populations(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True, schema="Person string, Ethnic string")
    return rows.select(F.col("Person").alias("sample_id"), F.col("Ethnic").alias("population"))


def write_report(df: DataFrame, path: str) -> None:
    """One CSV file with a header; for reports with a row per sample or variant."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)
