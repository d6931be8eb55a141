"""Ancestry from segments: composition of a sample and painting of its strands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Super-populations and their populations in the 1000 Genomes sample list.
SUPER_POPULATIONS = {
    "EAS": ["CHB", "JPT", "CHS", "CDX", "KHV"],
    "EUR": ["CEU", "TSI", "FIN", "GBR", "IBS"],
    "AFR": ["YRI", "LWK", "GWD", "MSL", "ESN", "ASW", "ACB"],
    "AMR": ["MXL", "PUR", "CLM", "PEL"],
    "SAS": ["GIH", "PJL", "BEB", "STU", "ITU"],
}


def population_to_super(spark) -> DataFrame:
    return spark.createDataFrame([(p, s) for s, ps in SUPER_POPULATIONS.items() for p in ps], "population string, super_population string")


def sample_to_super(populations: DataFrame) -> DataFrame:
    """(sample_id, population) -> (sample_id, super_population)."""
    return populations.join(population_to_super(populations.sparkSession), "population", "left").select("sample_id", "super_population")


def labelled(segments: DataFrame, populations: DataFrame) -> DataFrame:
    """Bounded segments with the population of the reference sample that haplotype hap_label belongs to."""
    sample = F.ceil(F.col("hap_label") / 2).cast("int")
    return segments.withColumn("ref_sample", sample).join(populations, "ref_sample", "left")


def composition(segments: DataFrame, populations: DataFrame, total: int) -> DataFrame:
    """(sample_idx, population, frac) for every sample and population that occurs anywhere; fractions of a sample sum to 1."""
    length = F.sum(F.col("end") - F.col("start") + 1)
    rows = labelled(segments, populations).groupBy("sample_idx", "population").agg((length / (2 * total)).alias("frac"))
    every = segments.select("sample_idx").distinct().join(F.broadcast(populations.select("population").distinct()))  # a row for each of the few populations
    return every.join(rows, ["sample_idx", "population"], "left").select("sample_idx", "population", F.coalesce("frac", F.lit(0.0)).alias("frac"))


def painted(segments: DataFrame, populations: DataFrame, total: int) -> DataFrame:
    """(sample_idx, strand, seg_no, frac, population); neighbours of one population stay apart."""
    return labelled(segments, populations).select("sample_idx", "strand", "seg_no", ((F.col("end") - F.col("start") + 1) / total).alias("frac"), "population")


def global_matrix(fractions: DataFrame, populations: list[str]) -> DataFrame:
    """One row per sample, one column per population."""
    return fractions.groupBy("sample_idx").pivot("population", populations).agg(F.first("frac")).na.fill(0.0)


def local_matrix(paint: DataFrame, segments: int) -> DataFrame:
    """One row per strand, fractions in columns 1 to segments, filled up with 0."""
    return paint.groupBy("sample_idx", "strand").pivot("seg_no", list(range(1, segments + 1))).agg(F.first("frac")).na.fill(0.0)


def segment_counts(segments: DataFrame) -> DataFrame:
    """Segments of each strand and the larger of the two."""
    n = segments.groupBy("sample_idx").agg(F.count_if(F.col("strand") == 1).alias("n1"), F.count_if(F.col("strand") == 2).alias("n2"))
    return n.withColumn("longest", F.greatest("n1", "n2"))


def mass_errors(fractions: DataFrame) -> DataFrame:
    """Samples whose fractions don't sum to 1."""
    return fractions.groupBy("sample_idx").agg(F.sum("frac").alias("mass")).filter(F.abs(F.col("mass") - 1) > 1e-9)
