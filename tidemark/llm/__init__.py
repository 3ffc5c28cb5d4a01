"""Operators for training-data pipelines: extraction, deduplication, filters and token output."""
