"""Phasing: candidate sets, survivor fold, breakpoints and mosaics; one grouped map per sample."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import phasing as P

SEGMENTS = "sample_idx int, strand int, seg_no int, start int, window int, hap_label int"


def with_members(best: DataFrame, members: DataFrame) -> DataFrame:
    """best pairs with m1 and m2, the sorted haplotypes that equal each on the window's typed variants."""
    m = members.select("window", "rep", "members")
    out = best.join(m.select("window", F.col("rep").alias("hap1"), F.col("members").alias("m1")), ["window", "hap1"])
    return out.join(m.select("window", F.col("rep").alias("hap2"), F.col("members").alias("m2")), ["window", "hap2"])


def phase_fold(candidates: DataFrame) -> DataFrame:
    """(sample_idx, window, m1, m2) -> labels hap1 and hap2 of each window after the survivor fold."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("window")
        one, two = P.survivor_fold([list(v) for v in pdf["m1"]], [list(v) for v in pdf["m2"]])
        return pd.DataFrame({"sample_idx": pdf["sample_idx"], "window": pdf["window"], "hap1": one, "hap2": two})

    return candidates.select("sample_idx", "window", "m1", "m2").groupBy("sample_idx").applyInPandas(run, "sample_idx int, window int, hap1 int, hap2 int")


def adjacent(labels: DataFrame, vectors: DataFrame, unique: DataFrame) -> DataFrame:
    """One row per sample and window w >= 2: labels i, j, k, l, values x over windows w - 1 and w, and the four labels' alleles there."""
    order = Window.partitionBy("sample_idx").orderBy("window")
    steps = labels.withColumns({"i": F.lag("hap1").over(order), "j": F.lag("hap2").over(order), "before": F.lag("window").over(order)})
    steps = steps.filter("before is not null").withColumnsRenamed({"hap1": "k", "hap2": "l"})
    x = vectors.select("sample_idx", "window", F.transform(F.arrays_zip("x", "seen"), lambda s: F.when(s.seen, s.x)).alias("x"))
    steps = steps.join(x, ["sample_idx", "window"]).withColumnRenamed("x", "x_now")
    steps = steps.join(x.withColumnsRenamed({"window": "before", "x": "x_before"}), ["sample_idx", "before"])
    roles = F.explode(F.array(*[F.struct(F.lit(role + side).alias("role"), F.col(role).alias("hap_idx"), F.col(w).alias("in_window")) for role in "ijkl" for side, w in (("0", "before"), ("1", "window"))]))
    asked = steps.select("sample_idx", "window", roles.alias("a")).select("sample_idx", "window", "a.*")
    bits = asked.join(unique.select(F.col("window").alias("in_window"), "hap_idx", "bits"), ["in_window", "hap_idx"])
    wide = bits.groupBy("sample_idx", "window").agg(*[F.concat(F.max(F.when(F.col("role") == role + "0", F.col("bits"))), F.max(F.when(F.col("role") == role + "1", F.col("bits")))).alias(f"bits_{role}") for role in "ijkl"])
    return steps.join(wide, ["sample_idx", "window"]).select("sample_idx", "window", *"ijkl", F.concat("x_before", "x_now").alias("x"), *[f"bits_{role}" for role in "ijkl"])


def _step(row):
    x = np.array([np.nan if v is None else v for v in row.x], float)
    alleles = [np.frombuffer(getattr(row, f"bits_{role}").encode(), np.uint8).astype(float) - 48 for role in "ijkl"]
    if any(len(a) != len(x) for a in alleles):
        raise ValueError(f"sample {row.sample_idx}, window {row.window}: {len(x)} values, but haplotypes of {[len(a) for a in alleles]}")
    return x, (row.i, row.j, row.k, row.l), alleles


def breakpoints(steps: DataFrame, double: bool = True) -> DataFrame:
    """(sample_idx, window, b1, b2) of rows made by adjacent(); -1: the strand doesn't change, -2: not searched."""
    def run(batches):
        for pdf in batches:
            found = [P.breakpoints(*_step(row), double) for row in pdf.itertuples()]
            yield pd.DataFrame({"sample_idx": pdf["sample_idx"], "window": pdf["window"], "b1": [b for b, _ in found], "b2": [b for _, b in found]})

    return steps.mapInPandas(run, "sample_idx int, window int, b1 int, b2 int")


def continued(steps: DataFrame, double: bool = False) -> DataFrame:
    """(sample_idx, window, hap1, hap2, b1, b2) of rows made by adjacent(), for pairs that are not in phase: the second pair as it is or turned, whichever lets a strand go on."""
    def run(batches):
        for pdf in batches:
            rows = []
            for row in pdf.itertuples():
                (k, l), (b1, b2) = P.oriented(*_step(row), double)
                rows.append((row.sample_idx, row.window, k, l, b1, b2))
            yield pd.DataFrame(rows, columns=["sample_idx", "window", "hap1", "hap2", "b1", "b2"])

    return steps.mapInPandas(run, "sample_idx int, window int, hap1 int, hap2 int, b1 int, b2 int")


def mosaics(labels: DataFrame, points: DataFrame, windows: DataFrame, form: str = "label") -> DataFrame:
    """Segments (sample_idx, strand, seg_no, start, window, hap_label) in typed coordinates.

    form "label": a segment per change of label (what ancestry and compressed output need); "window": every window begins one.
    """
    make = {"label": P.segments_by_label, "window": P.segments_by_window}[form]
    rows = labels.join(points, ["sample_idx", "window"], "left").join(windows.select("window", "x_start", "x_end"), "window")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("window")
        ranges = list(zip(pdf["x_start"], pdf["x_end"]))
        out = []
        for strand in (1, 2):
            found = make(pdf[f"hap{strand}"].tolist(), [int(b) for b in pdf[f"b{strand}"].iloc[1:]], ranges)
            out += [(int(pdf["sample_idx"].iloc[0]), strand, n, start, window, label) for n, (start, label, window) in enumerate(found, 1)]
        return pd.DataFrame(out, columns=["sample_idx", "strand", "seg_no", "start", "window", "hap_label"])

    return rows.groupBy("sample_idx").applyInPandas(run, SEGMENTS)


def connect_pairs(candidates: DataFrame, penalty: float = 1.0) -> DataFrame:
    """(sample_idx, window, pair_no, hap1, hap2) -> the least-error path: sample_idx, window, hap1, hap2, best_err."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        windows, pairs = [], []
        for window, part in pdf.sort_values(["window", "pair_no"]).groupby("window"):
            windows.append(window)
            pairs.append(list(zip(part["hap1"].tolist(), part["hap2"].tolist())))
        error, path = P.connect_pairs(pairs, penalty)
        return pd.DataFrame([(pdf["sample_idx"].iloc[0], w, a, b, error) for w, (a, b) in zip(windows, path)], columns=["sample_idx", "window", "hap1", "hap2", "best_err"])

    return candidates.groupBy("sample_idx").applyInPandas(run, "sample_idx int, window int, hap1 int, hap2 int, best_err double")


def survivor_overlap(candidates: DataFrame) -> DataFrame:
    """(sample_idx, window, m1, m2) -> sizes of the intersections with the window before: n1 and n2 strand by strand, crossed for both strands crossed over."""
    order = Window.partitionBy("sample_idx").orderBy("window")
    rows = candidates.withColumns({"o1": F.lag("m1").over(order), "o2": F.lag("m2").over(order)}).filter("o1 is not null")

    def common(a, b):
        return F.size(F.array_intersect(a, b))

    return rows.select("sample_idx", "window", common("o1", "m1").alias("n1"), common("o2", "m2").alias("n2"), (common("o1", "m2") + common("o2", "m1")).alias("crossed"))
