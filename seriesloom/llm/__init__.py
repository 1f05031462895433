"""Operators of a training-data pipeline: deduplication, language, mixing, packing, scans and filters."""
