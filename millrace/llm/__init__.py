"""Training-data operators: search, deduplication, packing, mixing, scoring.

Nothing else in the library imports this subpackage.
"""
