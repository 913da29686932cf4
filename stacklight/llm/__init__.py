"""Operators of a training-data pipeline: deduplication, search, quality, licences, tokens, packing."""
