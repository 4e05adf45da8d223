"""Operators of a training-data pipeline: filters, token counts, deduplication, packing and sharding."""
