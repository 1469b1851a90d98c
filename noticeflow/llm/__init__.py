"""Operators for training-data pipelines: text filters, de-duplication, scoring and packing."""
