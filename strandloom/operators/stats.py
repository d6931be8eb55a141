"""Companion statistics of genotypes: counts, filters, error rates and marker ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .panel import window_variants


def genotype_stats(genotypes: DataFrame) -> DataFrame:
    """Per variant: observed, missing, alternative frequency, minor frequency and chi-squared of Hardy-Weinberg equilibrium."""
    n = F.count("gt")
    counts = genotypes.groupBy("variant_idx").agg(
        n.alias("n"), F.count_if(F.col("gt").isNull()).alias("n_missing"), (F.sum("gt") / (2 * n)).alias("alt_freq"),
        F.count_if(F.col("gt") == 0).alias("n0"), F.count_if(F.col("gt") == 1).alias("n1"), F.count_if(F.col("gt") == 2).alias("n2"),
    )
    p, q = F.col("alt_freq"), 1 - F.col("alt_freq")

    def term(seen, share):
        expected = share * F.col("n")
        return F.when(expected > 0, F.pow(F.col(seen) - expected, 2.0) / F.when(expected > 0, expected)).otherwise(0.0)

    return counts.withColumns({"maf": F.least(p, q), "hwe": term("n0", q * q) + term("n1", 2 * p * q) + term("n2", p * p)})


def sample_stats(genotypes: DataFrame) -> DataFrame:
    return genotypes.groupBy("sample_idx").agg(F.count("gt").alias("n"), F.count_if(F.col("gt").isNull()).alias("n_missing"), F.sum("gt").alias("allele_sum"))


def minor_allele_filter(genotypes: DataFrame, least_maf: float = 0.0, least_mac: int = 0) -> DataFrame:
    """Variants by minor allele frequency and count."""
    stats = genotype_stats(genotypes).withColumn("mac", F.least(F.round(F.col("alt_freq") * 2 * F.col("n")), F.round((1 - F.col("alt_freq")) * 2 * F.col("n"))).cast("long"))
    return stats.filter((F.col("maf") > least_maf) & (F.col("mac") >= least_mac)).select("variant_idx", "maf", "mac")


def sampled_markers(variants: DataFrame, n: int, seed: int) -> DataFrame:
    """n variants chosen by hash, the same for the same seed."""
    return variants.withColumn("_order", F.xxhash64(F.lit(seed), "variant_idx")).orderBy("_order", "variant_idx").limit(n).drop("_order")


def restricted(variants: DataFrame, positions: DataFrame) -> DataFrame:
    """Variants at given positions (a chip's sites)."""
    return variants.join(positions.select("pos").distinct(), "pos", "left_semi")


def filtered(genotypes: DataFrame, variants: DataFrame, samples: DataFrame) -> DataFrame:
    """Genotypes of biallelic variants among `variants` and of `samples`."""
    kept = genotypes.join(variants.filter(F.size("alts") == 1).select("variant_idx"), "variant_idx", "left_semi")
    return kept.join(samples.select("sample_idx"), "sample_idx", "left_semi")


def masked(genotypes: DataFrame, condition) -> DataFrame:
    """genotypes with null where the condition holds; phased alleles are put together by unphased() first."""
    return genotypes.withColumn("gt", F.when(~condition, F.col("gt")))


def conformed(a: DataFrame, b: DataFrame) -> DataFrame:
    """Variants of a and b at one position with the same alleles."""
    return a.select("pos", "ref", F.col("alts")[0].alias("alt"), F.col("variant_idx").alias("a_idx")).join(b.select("pos", "ref", F.col("alts")[0].alias("alt"), F.col("variant_idx").alias("b_idx")), ["pos", "ref", "alt"])


def error_rate(truth: DataFrame, imputed: DataFrame) -> DataFrame:
    """Share of genotypes that differ; both (sample_idx, variant_idx, g)."""
    rows = truth.select("sample_idx", "variant_idx", F.col("g").alias("t")).join(imputed.select("sample_idx", "variant_idx", "g"), ["sample_idx", "variant_idx"])
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("t") != F.col("g")).cast("int")).alias("error_rate"))


def cumulative_r2(truth: DataFrame, imputed: DataFrame, counts: DataFrame, bins: list[int]) -> DataFrame:
    """Squared correlation of genotypes over all variants of a minor allele count up to each bin; counts (variant_idx, mac)."""
    rows = truth.select("sample_idx", "variant_idx", F.col("g").alias("t")).join(imputed.select("sample_idx", "variant_idx", "g"), ["sample_idx", "variant_idx"]).join(counts, "variant_idx")
    reached = rows.select("t", "g", F.explode(F.filter(F.array(*map(F.lit, bins)), lambda b: F.col("mac") <= b)).alias("bin"))
    return reached.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.pow(F.corr("t", "g"), 2.0).alias("r2"))


def minimac_r2(alleles: DataFrame) -> DataFrame:
    """Variance of the imputed alleles over p (1 - p), per variant; 1 for hard alleles, null where there is no variation."""
    p = F.avg("allele")
    return alleles.groupBy("variant_idx").agg(F.when((p > 0) & (p < 1), F.var_pop("allele") / (p * (1 - p))).alias("rsq"))


def informative_markers(haplotypes: DataFrame, populations: DataFrame, top: int) -> DataFrame:
    """The `top` variants of greatest chi-squared of allele by population; populations (hap_idx, population). top is the size of the report."""
    rows = haplotypes.join(populations, "hap_idx").groupBy("variant_idx", "population").agg(F.count(F.lit(1)).alias("n"), F.sum("allele").alias("ones"))
    total = rows.groupBy("variant_idx").agg((F.sum("ones") / F.sum("n")).alias("p"))
    share = F.col("ones") / F.col("n") - F.col("p")
    scored = rows.join(total, "variant_idx").filter("p > 0 and p < 1").groupBy("variant_idx").agg(F.sum(F.col("n") * share * share / (F.col("p") * (1 - F.col("p")))).alias("chi2"))
    return scored.orderBy(F.round("chi2", 6).desc(), "variant_idx").limit(top)


def edge_error_share(errors: DataFrame, windows: DataFrame, near: int) -> DataFrame:
    """Share of wrong genotypes that lie within `near` variants of a window's edge; errors (variant_idx, wrong)."""
    rows = errors.join(window_variants(windows), "variant_idx").join(windows.select("window", "h_start", "h_end"), "window")
    close = (F.col("variant_idx") - F.col("h_start") < near) | (F.col("h_end") - F.col("variant_idx") < near)
    return rows.agg(F.sum("wrong").alias("n_wrong"), F.sum(F.when(close, F.col("wrong")).otherwise(0)).alias("n_near_edge"))


def width_bin_errors(errors: DataFrame, windows: DataFrame) -> DataFrame:
    """Error rate by typed width of the window: up to 20, 50, 100, 200 or more."""
    width = F.col("x_end") - F.col("x_start") + 1
    bin_ = F.when(width <= 20, 20).when(width <= 50, 50).when(width <= 100, 100).when(width <= 200, 200).otherwise(1000)
    rows = errors.join(window_variants(windows), "variant_idx").join(windows.select("window", "x_start", "x_end"), "window")
    return rows.groupBy(bin_.alias("width_bin")).agg(F.sum("wrong").alias("n_wrong"), F.sum("n").alias("n"))


def pruned_samples(best: DataFrame, most: float) -> DataFrame:
    """Samples whose mean window score is `most` or less."""
    return best.groupBy("sample_idx").agg(F.avg("score").alias("mean_score")).filter(F.round("mean_score", 6) <= most)


def score_histogram(best: DataFrame, step: float) -> DataFrame:
    """Windows of each sample by score, in bins of width `step`: (sample_idx, bin, n), bin b from b * step on."""
    return best.groupBy("sample_idx", F.floor(F.round(F.col("score") / step, 6)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def record_counts(genotypes: DataFrame) -> DataFrame:
    """Records and samples of a table of genotypes."""
    return genotypes.agg(F.count_distinct("variant_idx").alias("n_records"), F.count_distinct("sample_idx").alias("n_samples"))


def without_populations(owners: DataFrame, populations: list[str]) -> DataFrame:
    """Reference samples that belong to none of the given populations (a panel that they are left out of)."""
    return owners.filter(~F.col("population").isin(populations))


def quality_filtered(scores: DataFrame, least: float) -> DataFrame:
    """Variants whose score is `least` or more."""
    return scores.filter(F.col("score") >= least)


def unphased(alleles: DataFrame) -> DataFrame:
    """(sample_idx, strand, variant_idx, allele) -> (sample_idx, variant_idx, gt): the sum of both strands' alleles, null if one is missing."""
    rows = alleles.groupBy("sample_idx", "variant_idx").agg(F.sum("allele").alias("s"), F.count("allele").alias("n"))
    return rows.select("sample_idx", "variant_idx", F.when(F.col("n") == 2, F.col("s")).alias("gt"))
