"""Operators of a training-data pipeline: tokens, mixing, near copies, quality, toxicity, personal data."""
