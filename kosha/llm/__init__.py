"""Operators of a training-data pipeline: packing, quality, search, toxicity, sharding, near copies,
page text, tokens, media columns and secrets. Nothing outside this package imports it."""
