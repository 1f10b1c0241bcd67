"""Operators for training-data pipelines: sharding, deduplication, scoring, packing, archives."""
