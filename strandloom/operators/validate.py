"""Checks of inputs; each is a DataFrame of offenders, or raises."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unknown_markers(typed: DataFrame, variants: DataFrame) -> DataFrame:
    """Typed positions that the panel lacks."""
    return typed.join(variants.select("pos"), "pos", "left_anti")


def reference_mismatches(typed: DataFrame, variants: DataFrame) -> DataFrame:
    """Matched positions whose REF alleles differ."""
    return typed.join(variants.select("pos", F.col("ref").alias("panel_ref")), "pos").filter("ref <> panel_ref")


def chromosomes(variants: DataFrame) -> DataFrame:
    return variants.groupBy("chrom").agg(F.count(F.lit(1)).alias("n_variants"))


def duplicate_markers(variants: DataFrame) -> DataFrame:
    """Variants at a position that an earlier one has."""
    first = variants.groupBy("pos").agg(F.min("variant_idx").alias("first_idx"))
    return variants.join(first, "pos").filter("variant_idx > first_idx")


def out_of_domain(genotypes: DataFrame) -> DataFrame:
    return genotypes.filter("gt is not null and gt not in (0, 1, 2)")


def checked(typed: DataFrame, variants: DataFrame) -> None:
    """Raise for the first failing check of a target against a panel."""
    if len(chromosomes(typed).limit(2).collect()) > 1:
        raise ValueError("the target has more than one chromosome")
    if bad := unknown_markers(typed, variants).orderBy("pos").limit(1).collect():
        raise ValueError(f"position {bad[0]['pos']} is not in the panel")
    if bad := reference_mismatches(typed, variants).orderBy("pos").limit(1).collect():
        raise ValueError(f"REF alleles differ at position {bad[0]['pos']}")
