"""Operators for preparing training data: language, mixing, dedup, packing, media, search."""
