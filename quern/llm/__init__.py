"""Operators for large-scale training data: mixing, packing, pair defects, near-duplicates, encoding, leaks, truncation."""
