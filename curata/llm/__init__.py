"""Operators of a training-data pipeline: tokens, packing, near-duplicates, archives,
page extraction, quality, toxicity, nearest neighbours. Nothing else in the library
imports this subpackage."""
