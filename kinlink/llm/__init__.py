"""Operators of a training-data pipeline: matching, normalising, grouping, packing, leak search, language labels."""
