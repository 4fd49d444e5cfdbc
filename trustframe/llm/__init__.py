"""Operators of a training-data pipeline: scans, scores, deduplication, mixing, packing and search."""
