"""Operators for preparing training data: scoring, filtering, deduplication, packing and sharding."""
