"""Operators for preparing training text: quality, deduplication, mixing, packing, extraction, search."""
