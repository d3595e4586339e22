"""Operators for building training data: filters, deduplication, mixing, sharding and formatting."""
