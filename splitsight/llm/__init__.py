"""Operators of a training-data pipeline: screening, deduplication, mixing, packing and search."""
