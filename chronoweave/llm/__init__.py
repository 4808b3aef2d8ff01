"""Operators for preparing training data: deduplication, mixing, packing, scoring and search.

Nothing else in the library imports this subpackage.
"""
