"""Operators for large training-data collections: overlaps, near-duplicates, splits, samples, packing and leaks."""
