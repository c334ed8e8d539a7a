"""Operators for training-data pipelines (mixing, extraction, filtering,
deduplication, tokenising, packing, search).

Nothing else in the library imports this subpackage.
"""
