"""Numbers and neighbours along a chromosome without one task for all rows: windows within blocks of positions, and a row per block for what lies before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def numbered(df: DataFrame, name: str, by: str, *ties: Column | str, first: str | None = None) -> DataFrame:
    """df with its rows' 1-based numbers in the order of `first` (if given), the integer column `by`, then ties.

    Rows are numbered within blocks of BLOCK values; blocks' counts are summed up apart, one row each.
    """
    lead = [first] if first else []
    rows = df.withColumn("_block", F.floor(F.col(by) / BLOCK))
    counts = rows.groupBy(*lead, "_block").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy(*lead, "_block").rowsBetween(Window.unboundedPreceding, -1))  # a row for each block
    offsets = counts.select(*lead, "_block", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(*lead, "_block").orderBy(by, *ties))
    return rows.withColumn("_at", within).join(offsets, [*lead, "_block"]).withColumn(name, (F.col("_before") + F.col("_at")).cast("int")).drop("_block", "_at", "_before")


def neighbours(df: DataFrame, value: str, by: str) -> DataFrame:
    """df with `before` and `after`: the last value that isn't null at or before a row in the order of `by`, and the first at or behind it."""
    rows = df.withColumn("_block", F.floor(F.col(by) / BLOCK))
    ends = rows.groupBy("_block").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(by))).alias("_last"), F.min_by(value, F.when(F.col(value).isNotNull(), F.col(by))).alias("_first"))
    order = Window.orderBy("_block")  # a row for each block
    ends = ends.select(
        "_block", F.last("_last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_b"), F.first("_first", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_a"),
    )
    inner = Window.partitionBy("_block").orderBy(by)
    back, ahead = inner.rowsBetween(Window.unboundedPreceding, 0), inner.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumns({"_l": F.last(value, ignorenulls=True).over(back), "_f": F.first(value, ignorenulls=True).over(ahead)}).join(ends, "_block")
    return rows.withColumns({"before": F.coalesce("_l", "_b"), "after": F.coalesce("_f", "_a")}).drop("_block", "_l", "_f", "_a", "_b")
