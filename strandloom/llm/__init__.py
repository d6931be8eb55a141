"""Operators of a training-data pipeline: deduplication, search, cleaning, packing and file formats."""
