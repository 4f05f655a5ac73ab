"""Operators that prepare training text: packing, extraction, deduplication, search, scoring, filtering, mixing, token files."""
