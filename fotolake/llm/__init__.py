"""Operators for training-data corpora: packing, formatting, dedup, counting, mixing, quality, toxicity and scoring."""
