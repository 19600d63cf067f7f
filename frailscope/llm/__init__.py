"""Operators for large-scale training data: filters, near-duplicates, models and encodings."""
