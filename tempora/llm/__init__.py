"""Operators of a large-scale training-data pipeline: tokens, duplicates, filters, packing.

Nothing else in the library imports this subpackage.
"""
