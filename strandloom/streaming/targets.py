"""Targets that arrive as a stream: a stateless search of each micro-batch against a static panel."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import search


def search_stream(genotypes: DataFrame, windows: DataFrame, typed: DataFrame, unique: DataFrame, frequency: DataFrame, out: str, checkpoint: str, **options):
    """Start a query that appends (sample_idx, window, hap1, hap2, score) of every batch of genotypes to Parquet in `out`.

    Missing entries are filled by the panel's frequency, so a sample's result doesn't depend on who arrives with it. A sample's rows must come in one batch. A batch is written under its own number, so a repeated one replaces itself.
    """
    def step(batch: DataFrame, number: int) -> None:
        vectors = search.window_vectors(search.mean_filled(batch, frequency), windows, typed)
        search.pair_search(vectors, unique, **options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return genotypes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()
