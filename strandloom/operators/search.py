"""Best haplotype pair of every sample in every window."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import search as S

FOUND = "sample_idx int, window int, hap1 int, hap2 int, score double"


def mean_filled(genotypes: DataFrame, frequency: DataFrame | None = None) -> DataFrame:
    """genotypes with x: gt, where missing the mean of the variant's observed entries, else 0.

    With the panel's frequency (variant_idx, alt_freq) the mean is twice that, so a sample's values don't depend on what other samples are there.
    """
    if frequency is not None:
        known = genotypes.join(frequency.select("variant_idx", (2 * F.col("alt_freq")).alias("_mean")), "variant_idx", "left")
        return known.withColumn("x", F.coalesce(F.col("gt").cast("double"), "_mean", F.lit(0.0))).drop("_mean")
    mean = F.avg("gt").over(Window.partitionBy("variant_idx"))
    return genotypes.withColumn("x", F.coalesce(F.col("gt").cast("double"), mean, F.lit(0.0)))


def allele_weights(frequency: DataFrame) -> DataFrame:
    """frequency (variant_idx, alt_freq) with weight; see functions.search.frequency_weight."""
    p = F.least(F.col("alt_freq"), F.lit(0.85))
    return frequency.withColumn("weight", F.when(p < 0.15, 1.98).otherwise(1 / F.sqrt(2 * p * (1 - p))))


def window_vectors(filled: DataFrame, windows: DataFrame, typed: DataFrame) -> DataFrame:
    """(window, sample_idx, x, seen): a window's typed values and whether they were observed, in order, as arrays."""
    spans = windows.select("window", F.explode(F.sequence("x_start", "x_end")).alias("x_idx")).join(typed.select("x_idx", "variant_idx"), "x_idx")
    rows = filled.join(spans, "variant_idx").groupBy("window", "sample_idx")
    listed = rows.agg(F.array_sort(F.collect_list(F.struct("variant_idx", "x", F.col("gt").isNotNull().alias("seen")))).alias("v"))
    return listed.select("window", "sample_idx", F.transform("v", lambda s: s.x).alias("x"), F.transform("v", lambda s: s.seen).alias("seen"))


def pair_search(
    vectors: DataFrame, unique: DataFrame, strategy: str = "global", weights: DataFrame | None = None, r: int = 1, keep: int = 20, max_haplotypes: int = 800, sample_block: int = 1024,
    rescreen: bool = False,
) -> DataFrame:
    """(sample_idx, window, hap1, hap2, score) with complete haplotype indices.

    vectors: window_vectors; unique: unique haplotypes on typed variants. strategy: global, rescreen, stepwise or thinning. The latter two
    screen windows of more than max_haplotypes unique haplotypes; smaller ones are searched globally, or by rescreening if `rescreen` is set or the strategy.
    weights: (window, weights array), used by all but rescreening, and by thinning for the distances alone.
    Windows and blocks of samples are the unit of work: a group holds at most d haplotypes and sample_block samples.
    """
    if strategy not in ("global", "rescreen", "stepwise", "thinning"):
        raise ValueError(f"no such strategy: {strategy}")
    reps = unique.filter("hap_idx = rep").select("window", "unique_idx", "rep", "bits")
    blocked = vectors.withColumn("block", F.floor(F.col("sample_idx") / sample_block).cast("int"))
    present = blocked.select("window", "block").distinct()
    panel = reps.join(present, "window")
    if weights is not None:
        panel = panel.join(weights, "window")
    names = ["sample_idx", "window", "hap1", "hap2", "score"]

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in names})
        right = right.sort_values("unique_idx")
        h = np.array([np.frombuffer(b.encode(), np.uint8) - 48 for b in right["bits"]], float)
        rep = right["rep"].to_numpy()
        w = np.asarray(right["weights"].iloc[0], float) if "weights" in right else None
        widths = {len(v) for v in left["x"]} | ({len(w)} if w is not None else set())
        if widths != {h.shape[1]}:
            raise ValueError(f"window {key[0]}: haplotypes have {h.shape[1]} variants, samples or weights {sorted(widths)}")
        x, seen = np.stack(left["x"].to_list()).astype(float), np.stack(left["seen"].to_list()).astype(bool)
        if not np.isfinite(x).all():
            raise ValueError(f"window {key[0]}: a genotype is missing or not finite after initialisation")
        screened = strategy in ("stepwise", "thinning") and len(h) > max_haplotypes
        if screened and strategy == "stepwise":
            found = S.stepwise(x, h, r, w)
        elif screened:
            found = S.thinned(x, h, keep, w)
        elif strategy == "rescreen" or rescreen:
            found = S.rescreened(x, h, seen)
        else:
            found = S.best_pairs(x, h, w)
        j, k, score = zip(*found)
        return pd.DataFrame({"sample_idx": left["sample_idx"].to_numpy(), "window": key[0], "hap1": rep[list(j)], "hap2": rep[list(k)], "score": score})

    # Both sides come from one plan, so the panel's keys get names of their own.
    panel = panel.withColumns({"panel_window": F.col("window") + 0, "panel_block": F.col("block") + 0}).drop("window", "block")
    return blocked.groupBy("window", "block").cogroup(panel.groupBy("panel_window", "panel_block")).applyInPandas(run, FOUND)


def window_weights(windows: DataFrame, typed: DataFrame, weighted: DataFrame) -> DataFrame:
    """(window, weights): the squared allele weights of a window's typed variants as an array (both factors of a product are scaled)."""
    spans = windows.select("window", F.explode(F.sequence("x_start", "x_end")).alias("x_idx")).join(typed.select("x_idx", "variant_idx"), "x_idx")
    rows = spans.join(weighted, "variant_idx").groupBy("window").agg(F.array_sort(F.collect_list(F.struct("variant_idx", "weight"))).alias("v"))
    return rows.select("window", F.transform("v", lambda s: s.weight * s.weight).alias("weights"))


def observed_errors(pairs: DataFrame, vectors: DataFrame, unique: DataFrame) -> DataFrame:
    """(sample_idx, window, hap1, hap2, error): squared error on observed entries of the given pairs, of any window."""
    bits = unique.select("window", "hap_idx", "bits")
    joined = pairs.join(vectors, ["window", "sample_idx"])
    for n in (1, 2):
        joined = joined.join(bits.select("window", F.col("hap_idx").alias(f"hap{n}"), F.col("bits").alias(f"bits{n}")), ["window", f"hap{n}"])
    at = F.sequence(F.lit(0), F.size("x") - 1)

    def term(i):
        allele = F.substring("bits1", i + 1, F.lit(1)).cast("int") + F.substring("bits2", i + 1, F.lit(1)).cast("int")
        return F.when(F.get("seen", i), F.pow(F.get("x", i) - allele, F.lit(2.0))).otherwise(0.0)

    return joined.select("sample_idx", "window", "hap1", "hap2", F.aggregate(F.transform(at, term), F.lit(0.0), lambda a, b: a + b).alias("error"))


def flanking_screen(best: DataFrame, vectors: DataFrame, unique: DataFrame) -> DataFrame:
    """Replace a window's pair by the previous or next window's where that has a strictly lower observed error; ties keep own, then previous."""
    order = Window.partitionBy("sample_idx").orderBy("window")
    near = best.withColumns({f"{side}{n}": f(f"hap{n}").over(order) for side, f in (("before", F.lag), ("after", F.lead)) for n in (1, 2)})
    turns = [("hap1", "hap2"), ("before1", "before2"), ("after1", "after2")]
    tries = near.select("sample_idx", "window", F.explode(F.array(*[F.struct(F.lit(turn).alias("turn"), F.col(a).alias("hap1"), F.col(b).alias("hap2")) for turn, (a, b) in enumerate(turns)])).alias("t"))
    tries = tries.select("sample_idx", "window", "t.turn", "t.hap1", "t.hap2").filter("hap1 is not null")
    errors = observed_errors(tries.select("sample_idx", "window", "hap1", "hap2").distinct(), vectors, unique)
    scored = tries.join(errors, ["sample_idx", "window", "hap1", "hap2"])
    pick = scored.groupBy("sample_idx", "window").agg(F.min_by(F.struct("hap1", "hap2", "error"), F.struct("error", "turn")).alias("p"))
    return pick.select("sample_idx", "window", "p.hap1", "p.hap2", "p.error")


def redundant_pairs(best: DataFrame, members: DataFrame, limit: int = 1000) -> DataFrame:
    """All pairs of complete haplotypes that look like a window's best pair, the first `limit` of them per sample and window."""
    m = members.select("window", "rep", "members")
    both = best.join(m.select("window", F.col("rep").alias("hap1"), F.col("members").alias("m1")), ["window", "hap1"])
    both = both.join(m.select("window", F.col("rep").alias("hap2"), F.col("members").alias("m2")), ["window", "hap2"])
    pairs = F.flatten(F.transform(F.slice("m1", F.lit(1), F.ceil(limit / F.size("m2")).cast("int")), lambda a: F.transform(F.slice("m2", 1, limit), lambda b: F.struct(a.alias("h1"), b.alias("h2")))))
    rows = both.select("sample_idx", "window", F.posexplode(F.slice(pairs, 1, limit)).alias("n", "p"))
    return rows.select("sample_idx", "window", (F.col("n") + 1).alias("pair_no"), "p.h1", "p.h2")


def top_haplotypes(vectors: DataFrame, unique: DataFrame, r: int) -> DataFrame:
    """(sample_idx, window, unique_idx, n, nth): the r unique haplotypes of largest N = 2 x h of each sample and window, ties to the smaller index; r is the report's size."""
    reps = unique.filter("hap_idx = rep").select("window", "unique_idx", "bits")
    at = F.sequence(F.lit(0), F.size("x") - 1)
    n = F.aggregate(F.transform(at, lambda i: 2 * F.get("x", i) * F.substring("bits", i + 1, F.lit(1)).cast("double")), F.lit(0.0), lambda a, b: a + b)
    order = Window.partitionBy("sample_idx", "window").orderBy(F.round("n", 6).desc(), "unique_idx")
    rows = vectors.join(reps, "window").withColumn("n", n).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= r)
    return rows.select("sample_idx", "window", "unique_idx", "n", "nth")
