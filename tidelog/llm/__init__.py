"""Operators for preparing training text: packing, deduplication, quality,
toxicity, personal data, sharding, vector search and token files.

Nothing outside this subpackage imports it.
"""
