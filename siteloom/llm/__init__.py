"""Training-data operators: extraction, tokenising, archives, search, packing,
sharding, deduplication, language identification and secret scans.

Nothing outside this subpackage imports it.
"""
