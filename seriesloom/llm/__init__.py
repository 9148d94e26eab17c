"""Operators of a training-data pipeline: cleaning, dedup, search, tokens, packing."""
