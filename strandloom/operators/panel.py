"""Panel compression: frequencies, windows, unique haplotypes of each window and index translation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import BLOCK, numbered


def allele_frequency(haplotypes: DataFrame) -> DataFrame:
    return haplotypes.groupBy("variant_idx").agg(F.avg("allele").alias("alt_freq"))


def typed_index(typed: DataFrame, variants: DataFrame) -> DataFrame:
    """x_idx (place among typed variants) and variant_idx of each typed position: an equi-join on position."""
    return numbered(typed.select("pos").join(variants.select("pos", "variant_idx"), "pos"), "x_idx", "variant_idx")


def strands(haplotypes: DataFrame, at: str = "variant_idx") -> DataFrame:
    """(block, first, hap_idx, bits): alleles of each haplotype by the column `at` (from 1 on, without gaps) as strings, in blocks of BLOCK places. One shuffle; all that follows reads strings."""
    rows = haplotypes.withColumn("block", F.floor((F.col(at) - 1) / BLOCK)).groupBy("block", "hap_idx")
    listed = rows.agg(F.min(at).alias("first"), F.array_sort(F.collect_list(F.struct(at, "allele"))).alias("v"))
    return listed.select("block", "first", "hap_idx", F.array_join(F.transform("v", lambda s: s.allele), "").alias("bits"))


def cut(strands_: DataFrame, ranges: DataFrame, key: list[str]) -> DataFrame:
    """(key, hap_idx, bits) of ranges (key, lo, hi) of places. The ranges, which the driver has made, go to every task; a range is put together from its blocks."""
    spans = ranges.select(*key, "lo", "hi", F.explode(F.sequence(F.floor((F.col("lo") - 1) / BLOCK), F.floor((F.col("hi") - 1) / BLOCK))).alias("block"))
    lo = F.greatest("lo", "first")
    part = F.substring("bits", lo - F.col("first") + 1, F.col("hi") - lo + 1)
    rows = strands_.join(F.broadcast(spans), "block").select(*key, "hap_idx", F.struct("block", part.alias("part")).alias("piece"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda s: s.part), "")
    return rows.groupBy(*key, "hap_idx").agg(whole.alias("bits"))


def distinct_counts(strands_: DataFrame, ranges: DataFrame, key: list[str]) -> DataFrame:
    """(key, n): different haplotypes of each range; long ones are compared by digest."""
    bits = F.when(F.length("bits") > 32, F.md5("bits")).otherwise(F.col("bits"))
    return cut(strands_, ranges, key).groupBy(*key).agg(F.count_distinct(bits).alias("n"))


def bisected(strands_: DataFrame, n_typed: int, d: int = 1000, minwidth: int = 0) -> list[tuple[int, int]]:
    """Typed ranges found by halving [1, n_typed] until a range has d distinct haplotypes at most or its half is no wider than minwidth.

    One aggregation per level over the strings of strands(..., "x_idx"), for the ranges still open; the driver holds the ranges alone.
    """
    if d < 2:
        raise ValueError("d must be 2 or more")
    spark = strands_.sparkSession
    open_, done = [(1, n_typed)], []
    while open_:
        table = spark.createDataFrame(open_, "lo int, hi int").selectExpr("lo", "hi", "lo as a", "hi as b")
        counts = {(r["a"], r["b"]): r["n"] for r in distinct_counts(strands_, table, ["a", "b"]).collect()}
        split = []
        for lo, hi in open_:
            mid = (lo + hi) >> 1
            if lo == hi or counts[lo, hi] <= d or mid - lo + 1 <= minwidth:
                done.append((lo, hi))
            else:
                split += [(lo, mid), (mid + 1, hi)]
        open_ = split
    return sorted(done)


def windows_from_ranges(ranges: DataFrame, typed: DataFrame, n_variants) -> DataFrame:
    """ranges (window, x_start, x_end) with h_start and h_end: a window's variants end before the next one's first typed variant."""
    first = ranges.join(typed.select(F.col("x_idx").alias("x_start"), F.col("variant_idx").alias("first_idx")), "x_start")
    order = Window.orderBy("window")
    return first.select(
        "window", "x_start", "x_end",
        F.when(F.col("window") == 1, 1).otherwise(F.col("first_idx")).alias("h_start"),
        F.coalesce(F.lead("first_idx").over(order) - 1, F.lit(n_variants)).alias("h_end"),
    )


def padded(windows: DataFrame, overlap: float, n_typed: int) -> DataFrame:
    """Typed ranges with flanks of ceil(overlap * (x_end - x_start)) on each side, cut at the ends; none before the first and behind the last window."""
    flank = F.ceil(overlap * (F.col("x_end") - F.col("x_start")))
    order = Window.orderBy("window")
    return windows.select(
        "window", "x_start", "x_end",
        F.when(F.lag("window").over(order).isNull(), F.col("x_start")).otherwise(F.greatest(F.lit(1), F.col("x_start") - flank)).alias("x_start_pad"),
        F.when(F.lead("window").over(order).isNull(), F.col("x_end")).otherwise(F.least(F.lit(n_typed), F.col("x_end") + flank)).alias("x_end_pad"),
    )


def window_variants(windows: DataFrame) -> DataFrame:
    return windows.select("window", F.explode(F.sequence("h_start", "h_end")).alias("variant_idx"))


def inner_rows(padded_: DataFrame) -> DataFrame:
    """(window, x_idx, inner_row): of each typed variant of a window with flanks, whether it is in the window itself."""
    spans = padded_.select("window", F.explode(F.sequence(F.col("x_start_pad").cast("int"), F.col("x_end_pad").cast("int"))).alias("x_idx"), "x_start", "x_end")
    return spans.withColumn("inner_row", F.col("x_idx").between(F.col("x_start"), F.col("x_end")))


def unique_haplotypes(strands_: DataFrame, windows: DataFrame, lo: str = "h_start", hi: str = "h_end") -> DataFrame:
    """(window, hap_idx, bits, rep, unique_idx): rep is the first haplotype of the same bits, unique_idx its rank in the window.

    lo and hi name the windows' columns with the places in the strings of strands(): variant_idx or x_idx, flanks included where they are asked for.
    One shuffle of strings by (window, hap_idx), one by window that ranks the representatives only.
    """
    keyed = cut(strands_, windows.select("window", F.col(lo).cast("int").alias("lo"), F.col(hi).cast("int").alias("hi")), ["window"])
    reps = keyed.groupBy("window", "bits").agg(F.min("hap_idx").alias("rep"))
    reps = reps.withColumn("unique_idx", F.row_number().over(Window.partitionBy("window").orderBy("rep")))
    return keyed.join(reps, ["window", "bits"]).select("window", "hap_idx", "bits", "rep", "unique_idx")


def window_haps(unique: DataFrame) -> DataFrame:
    """(window, unique_idx, rep, bits, members, n_members) of each unique haplotype."""
    return unique.groupBy("window", "unique_idx", "rep", "bits").agg(F.sort_array(F.collect_list("hap_idx")).alias("members"), F.count(F.lit(1)).alias("n_members"))


def translations(everything: DataFrame, typed: DataFrame) -> DataFrame:
    """For each window and haplotype the five index translations, between complete, unique-all and unique-typed indices."""
    a = everything.select("window", "hap_idx", F.col("unique_idx").alias("all_idx"), F.col("rep").alias("all_rep"))
    t = typed.select("window", "hap_idx", F.col("unique_idx").alias("typed_idx"), F.col("rep").alias("typed_rep"))
    back = a.select("window", F.col("hap_idx").alias("typed_rep"), F.col("all_idx").alias("typed_to_all"))
    return a.join(t, ["window", "hap_idx"]).join(back, ["window", "typed_rep"])


def window_widths(windows: DataFrame) -> DataFrame:
    return windows.select("window", (F.col("x_end") - F.col("x_start") + 1).alias("width"))


def haplotypes_per_window(unique: DataFrame) -> DataFrame:
    return unique.groupBy("window").agg(F.max("unique_idx").alias("n_unique"))


def summary(windows: DataFrame, unique: DataFrame) -> DataFrame:
    """Number of windows and haplotypes, widest window, most and mean unique haplotypes."""
    counts = unique.groupBy("window").agg(F.max("unique_idx").alias("n_unique"), F.count(F.lit(1)).alias("n_haps"))
    return counts.join(windows, "window").agg(
        F.count(F.lit(1)).alias("n_windows"), F.max("n_haps").alias("n_haplotypes"), F.max(F.col("x_end") - F.col("x_start") + 1).alias("max_width"),
        F.max("n_unique").alias("max_unique"), F.avg("n_unique").alias("mean_unique"),
    )
