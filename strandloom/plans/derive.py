"""A haplotype panel, targets with known truth and label segments, derived from the driver's tables.

Panel: haplotype vec_id + 1 has the alternative allele at variant i where component i of its vector is positive; the
population of reference sample s is the label of haplotype 2 s - 1. Typed variants are those whose index isn't a
multiple of 4. Targets, one for 50 haplotypes but ten at least, copy panel haplotypes in runs of 16 variants, by the rule in `truth`; their genotypes are masked by another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

N_VARIANTS, HAPLOTYPES_PER_TARGET, PER_WINDOW = 64, 50, 8


def haplotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select((F.col("vec_id") + 1).cast("int").alias("hap_idx"), F.posexplode("embedding").alias("p", "v"))
    return rows.select((F.col("p") + 1).cast("int").alias("variant_idx"), "hap_idx", (F.col("v") > 0).cast("int").alias("allele"))


def populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("vec_id % 2 = 0")
    return rows.select((F.col("vec_id") / 2 + 1).cast("int").alias("ref_sample"), F.concat(F.lit("P"), "label").alias("population"))


def variants(spark: SparkSession) -> DataFrame:
    i = F.col("id") + 1
    return spark.range(N_VARIANTS).select(
        i.cast("int").alias("variant_idx"), F.lit("1").alias("chrom"), (1000 + 10 * i).alias("pos"), F.array(F.concat(F.lit("rs"), i)).alias("ids"),
        F.element_at(F.array(*map(F.lit, "ACGT")), (i % 4 + 1).cast("int")).alias("ref"), F.array(F.element_at(F.array(*map(F.lit, "CGTA")), (i % 4 + 1).cast("int"))).alias("alts"),
    )


def typed(spark: SparkSession) -> DataFrame:
    i = F.col("variant_idx")
    return variants(spark).filter(i % 4 != 0).select("variant_idx", "pos", "chrom", "ref", (i - F.floor(i / 4)).cast("int").alias("x_idx"))


def windows(spark: SparkSession) -> DataFrame:
    w = F.col("id") + 1
    k = PER_WINDOW - PER_WINDOW // 4
    return spark.range(N_VARIANTS // PER_WINDOW).select(*(e.cast("int").alias(n) for n, e in (
        ("window", w), ("x_start", (w - 1) * k + 1), ("x_end", w * k), ("h_start", (w - 1) * PER_WINDOW + 1), ("h_end", w * PER_WINDOW))))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_idx, strand, variant_idx, allele) of the targets."""
    panel = haplotypes(spark, sf_dir)
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").agg(F.max("vec_id").alias("m")).select((F.col("m") + 1).alias("m"), (F.col("m") + 1 - 20).alias("n"))  # one row
    samples = n.select("n", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(10), (F.col("m") / HAPLOTYPES_PER_TARGET).cast("int")))).alias("sample_idx"))
    both = samples.select("n", "sample_idx", F.explode(F.array(F.lit(1), F.lit(2))).alias("strand"))
    grid = both.select("n", "sample_idx", "strand", F.explode(F.sequence(F.lit(1), F.lit(N_VARIANTS))).alias("variant_idx"))
    picked = grid.withColumn("hap_idx", ((F.col("sample_idx") * 37 + F.col("strand") * 101 + F.floor((F.col("variant_idx") - 1) / 16) * 53) % F.col("n") + 21).cast("int"))
    return picked.drop("n").join(panel, ["variant_idx", "hap_idx"]).select("sample_idx", "strand", "variant_idx", "allele")


def true_dosage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth(spark, sf_dir).groupBy("sample_idx", "variant_idx").agg(F.sum("allele").cast("int").alias("g"))


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed genotypes, masked."""
    lost = (F.col("sample_idx") * 13 + F.col("variant_idx") * 7) % 11 == 0
    return true_dosage(spark, sf_dir).filter("variant_idx % 4 <> 0").select("variant_idx", "sample_idx", F.when(~lost, F.col("g")).alias("gt"))


def event_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one event_type among a user's events in time order, as bounded segments (sample_idx, strand 1, seg_no, start, end, label)."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", F.row_number().over(order).alias("n"), F.lag("event_type").over(order).alias("last"))
    runs = rows.withColumn("seg_no", F.sum(F.when(F.col("last") == F.col("event_type"), 0).otherwise(1)).over(Window.partitionBy("user_id").orderBy("n")))
    return runs.groupBy("user_id", "seg_no").agg(F.min("n").alias("start"), F.max("n").alias("end"), F.first("event_type").alias("label"))


def wide_panel(spark: SparkSession, sf_dir: str, copies: int = 16, targets: int = 100) -> dict[str, DataFrame]:
    """A panel of 64 * copies variants of the same haplotypes and `targets` masked targets, for timing: haplotypes, variants, samples, typed, truth, genotypes.

    Variant 64 c + i has the alternative allele where component i plus half of component i + c + 1 (around the end) is positive.
    """
    v, at = F.col("embedding"), F.sequence(F.lit(0), F.lit(N_VARIANTS - 1))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select((F.col("vec_id") + 1).cast("int").alias("hap_idx"), v, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("c"))
    signs = F.transform(at, lambda i: (F.get(v, i) + 0.5 * F.get(v, F.pmod(i + F.col("c") + 1, F.lit(N_VARIANTS))) > 0).cast("int"))
    haps = rows.select("hap_idx", "c", F.posexplode(signs).alias("i", "allele")).select((F.col("c") * N_VARIANTS + F.col("i") + 1).cast("int").alias("variant_idx"), "hap_idx", "allele")
    i = F.col("id") + 1
    variants_ = spark.range(N_VARIANTS * copies).select(i.cast("int").alias("variant_idx"), F.lit("1").alias("chrom"), (1000 + 10 * i).alias("pos"), F.array(F.concat(F.lit("rs"), i)).alias("ids"), F.lit("A").alias("ref"), F.array(F.lit("C")).alias("alts"))
    samples = haps.select(F.ceil(F.col("hap_idx") / 2).cast("int").alias("sample_idx")).distinct().withColumn("sample_id", F.concat(F.lit("r"), "sample_idx"))
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    grid = spark.range(targets).select((F.col("id") + 1).cast("int").alias("sample_idx"), F.explode(F.array(F.lit(1), F.lit(2))).alias("strand"))
    grid = grid.select("sample_idx", "strand", F.explode(F.sequence(F.lit(1), F.lit(N_VARIANTS * copies))).alias("variant_idx"))
    picked = grid.withColumn("hap_idx", ((F.col("sample_idx") * 37 + F.col("strand") * 101 + F.floor((F.col("variant_idx") - 1) / 200) * 53) % n + 1).cast("int"))
    truth_ = picked.join(haps, ["variant_idx", "hap_idx"]).groupBy("sample_idx", "variant_idx").agg(F.sum("allele").cast("int").alias("g"))
    lost = (F.col("sample_idx") * 13 + F.col("variant_idx") * 7) % 11 == 0
    genotypes_ = truth_.filter("variant_idx % 4 <> 0").select("variant_idx", "sample_idx", F.when(~lost, F.col("g")).alias("gt"))
    return {"haplotypes": haps, "variants": variants_, "samples": samples, "typed": variants_.filter("variant_idx % 4 <> 0"), "truth": truth_, "genotypes": genotypes_}
