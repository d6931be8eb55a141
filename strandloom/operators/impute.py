"""Segments to alleles, imputation, scores and decompression: joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import neighbours


def bounded(segments: DataFrame, total) -> DataFrame:
    """segments with end: a segment runs to the next one's start, the last to `total`."""
    order = Window.partitionBy("sample_idx", "strand").orderBy("seg_no")
    return segments.withColumn("end", F.coalesce(F.lead("start").over(order) - 1, F.lit(total)))


def lifted(segments: DataFrame, typed: DataFrame) -> DataFrame:
    """Starts from typed to panel coordinates; a strand's first segment begins at 1."""
    joined = segments.join(typed.select(F.col("x_idx").alias("start"), "variant_idx"), "start")
    return joined.withColumn("start", F.when(F.col("seg_no") == 1, 1).otherwise(F.col("variant_idx"))).drop("variant_idx")


def expanded(segments: DataFrame, haplotypes: DataFrame) -> DataFrame:
    """(sample_idx, strand, variant_idx, allele) of bounded segments in panel coordinates: an equi-join after the range is exploded."""
    rows = segments.filter("start <= end").select("sample_idx", "strand", F.col("hap_label").alias("hap_idx"), F.explode(F.sequence("start", "end")).alias("variant_idx"))
    return rows.join(haplotypes.select("variant_idx", "hap_idx", "allele"), ["variant_idx", "hap_idx"]).select("sample_idx", "strand", "variant_idx", "allele")


def pieces(segments: DataFrame, windows: DataFrame) -> DataFrame:
    """Bounded segments (panel coordinates) cut at windows: (sample_idx, strand, hap_label, window, lo, hi, at), at: the window's first variant.

    A segment that is labelled with window w begins in w - 1 or w, and ends where the next one begins; so its windows are known but for the two ends.
    """
    order = Window.partitionBy("sample_idx", "strand").orderBy("seg_no")
    last = windows.agg(F.max("window").alias("_last"))
    until = F.coalesce(F.lead("window").over(order), F.col("_last"))
    rows = segments.join(F.broadcast(last)).withColumn("_until", until)  # a single row
    rows = rows.select("sample_idx", "strand", "hap_label", "start", "end", F.explode(F.sequence(F.greatest(F.col("window") - 1, F.lit(1)), F.greatest("_until", "window"))).alias("window"))
    rows = rows.join(windows.select("window", "h_start", "h_end"), "window").filter((F.col("start") <= F.col("h_end")) & (F.col("end") >= F.col("h_start")))
    return rows.select("sample_idx", "strand", "hap_label", "window", F.greatest("start", "h_start").alias("lo"), F.least("end", "h_end").alias("hi"), F.col("h_start").alias("at"))


def strands_by_window(segments: DataFrame, windows: DataFrame, unique: DataFrame) -> DataFrame:
    """(sample_idx, window, at, bits1, bits2): the alleles of both strands in a window, from a compressed panel; at: the window's first variant.

    The join is by window and haplotype, and a piece's alleles are a part of its haplotype's bits there; no row is made for a single variant.
    """
    bits = unique.select("window", F.col("hap_idx").alias("hap_label"), "bits")
    part = F.substring("bits", F.col("lo") - F.col("at") + 1, F.col("hi") - F.col("lo") + 1)
    rows = pieces(segments, windows).join(bits, ["window", "hap_label"]).select("sample_idx", "window", "at", "strand", F.struct("lo", part.alias("part")).alias("piece"))

    def whole(strand):
        own = F.array_sort(F.collect_list(F.when(F.col("strand") == strand, F.col("piece"))))
        return F.array_join(F.transform(own, lambda s: s.part), "").alias(f"bits{strand}")

    return rows.groupBy("sample_idx", "window", "at").agg(whole(1), whole(2))


def expanded_by_window(segments: DataFrame, windows: DataFrame, unique: DataFrame) -> DataFrame:
    """As expanded(), from a compressed panel."""
    return alleles_of(strands_by_window(segments, windows, unique))


def _digit(bits, at):
    return F.substring(bits, at, F.lit(1)).cast("int")


def alleles_of(strands: DataFrame) -> DataFrame:
    """(sample_idx, strand, variant_idx, allele) of strands_by_window()."""
    both = strands.select("sample_idx", "at", F.posexplode(F.array("bits1", "bits2")).alias("side", "bits"))
    rows = both.select("sample_idx", (F.col("side") + 1).alias("strand"), "at", F.posexplode(F.split("bits", "")).alias("n", "allele")).filter("allele <> ''")
    return rows.select("sample_idx", "strand", (F.col("at") + F.col("n")).alias("variant_idx"), F.col("allele").cast("int").alias("allele"))


def dosages_of(strands: DataFrame) -> DataFrame:
    """(sample_idx, variant_idx, a1, a2, g) of strands_by_window(), without a shuffle."""
    pairs = F.arrays_zip(F.split("bits1", "").alias("x"), F.split("bits2", "").alias("y"))
    rows = strands.select("sample_idx", "at", F.posexplode(pairs).alias("n", "p")).select("sample_idx", (F.col("at") + F.col("n")).alias("variant_idx"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    return rows.filter("x <> ''").select("sample_idx", "variant_idx", F.col("x").cast("int").alias("a1"), F.col("y").cast("int").alias("a2"), (F.col("x").cast("int") + F.col("y").cast("int")).alias("g"))


def squared_errors(strands: DataFrame, vectors: DataFrame, windows: DataFrame, typed: DataFrame) -> DataFrame:
    """(sample_idx, window, errors): of each observed typed variant of a window (variant_idx, e), e the squared difference of genotype and alleles; a join by sample and window."""
    spans = windows.select("window", "h_start", F.explode(F.sequence("x_start", "x_end")).alias("x_idx")).join(typed.select("x_idx", "variant_idx"), "x_idx")
    places = spans.groupBy("window", "h_start").agg(F.array_sort(F.collect_list("variant_idx")).alias("typed"))
    rows = strands.select("sample_idx", "window", "bits1", "bits2").join(vectors.select("sample_idx", "window", "x", "seen"), ["sample_idx", "window"]).join(places, "window")

    def error(s):
        at = s["typed"] - F.col("h_start") + 1
        return F.struct(s["typed"].alias("variant_idx"), F.pow(s["x"] - _digit(F.col("bits1"), at) - _digit(F.col("bits2"), at), F.lit(2.0)).alias("e"))

    zipped = F.filter(F.arrays_zip("typed", "x", "seen"), lambda s: s["seen"])
    return rows.select("sample_idx", "window", F.transform(zipped, error).alias("errors"))


def scores_by_variant(errors: DataFrame, typed: DataFrame) -> DataFrame:
    """Of squared_errors(): 1 - mean squared error / 4 of each typed variant; null where nothing was observed."""
    found = errors.select(F.explode("errors").alias("s")).groupBy(F.col("s.variant_idx").alias("variant_idx")).agg((1 - 0.25 * F.avg("s.e")).alias("score"))
    return typed.select("variant_idx").join(found, "variant_idx", "left")


def scores_by_sample(errors: DataFrame) -> DataFrame:
    total = F.sum(F.aggregate("errors", F.lit(0.0), lambda a, s: a + s["e"]))
    return errors.groupBy("sample_idx").agg((1 - 0.25 * total / F.nullif(F.sum(F.size("errors")), F.lit(0))).alias("score"))


def segment_at(points: DataFrame, segments: DataFrame) -> DataFrame:
    """As-of join: each point (sample_idx, strand, variant_idx) with the label of the last segment that starts at or before it."""
    marks = segments.select("sample_idx", "strand", F.col("start").alias("variant_idx"), F.lit(0).alias("kind"), "hap_label")
    asks = points.select("sample_idx", "strand", "variant_idx", F.lit(1).alias("kind"), F.lit(None).cast(segments.schema["hap_label"].dataType).alias("hap_label"))
    order = Window.partitionBy("sample_idx", "strand").orderBy("variant_idx", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return marks.unionByName(asks).withColumn("hap_label", F.last("hap_label", ignorenulls=True).over(order)).filter("kind = 1").drop("kind")


def dosages(alleles: DataFrame) -> DataFrame:
    """Sum of both strands, and each."""
    return alleles.groupBy("sample_idx", "variant_idx").agg(
        F.max(F.when(F.col("strand") == 1, F.col("allele"))).alias("a1"), F.max(F.when(F.col("strand") == 2, F.col("allele"))).alias("a2"), F.sum("allele").alias("g")
    )


def keep_observed(dosage: DataFrame, genotypes: DataFrame) -> DataFrame:
    """Unphased imputation: observed genotypes stay, only missing and untyped ones come from the haplotypes."""
    known = genotypes.filter("gt is not null").select("sample_idx", "variant_idx", "gt")
    return dosage.join(known, ["sample_idx", "variant_idx"], "left").select("sample_idx", "variant_idx", F.coalesce("gt", "g").alias("g"), F.col("gt").isNotNull().alias("observed"))


def fill_missing(genotypes: DataFrame, dosage: DataFrame) -> DataFrame:
    """Missing entries from the haplotypes; with the number of disagreements among observed entries per sample."""
    rows = genotypes.join(dosage, ["sample_idx", "variant_idx"])
    return rows.groupBy("sample_idx").agg(
        F.count_if(F.col("gt").isNull()).alias("n_filled"), F.count_if(F.col("gt") != F.col("g")).alias("n_different"), F.sum(F.coalesce("gt", "g")).alias("allele_sum")
    )


def _score():
    return 1 - 0.25 * F.avg(F.pow(F.col("gt") - F.col("g"), 2.0))


def typed_scores(genotypes: DataFrame, dosage: DataFrame, by: str) -> DataFrame:
    """1 - mean squared error / 4 over observed entries, per variant_idx or sample_idx; null where nothing was observed."""
    return genotypes.join(dosage, ["sample_idx", "variant_idx"]).groupBy(by).agg(_score().alias("score"))


def variant_scores(typed: DataFrame, variants: DataFrame) -> DataFrame:
    """Scores of all variants: an untyped one has the mean of its typed neighbours' scores, at the ends the nearest one's."""
    rows = neighbours(variants.select("variant_idx").join(typed.withColumn("typed", F.lit(True)), "variant_idx", "left"), "score", "variant_idx")
    mean = (F.coalesce("before", "after") + F.coalesce("after", "before")) / 2
    return rows.select("variant_idx", F.when(F.col("typed"), F.col("score")).otherwise(mean).alias("score"), F.coalesce("typed", F.lit(False)).alias("typed"))
