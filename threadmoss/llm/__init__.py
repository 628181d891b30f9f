"""Operators of a training-data pipeline: linkage, grouping, encoding, packing and truncation."""
