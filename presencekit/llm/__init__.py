"""Training-data operators: mixing, deduplication, quality, packing, search, scoring.

Nothing outside this subpackage imports it. ``queries`` registers the driver queries.
"""
