"""Operators on training text: matching, repair, deduplication, packing, leak search, subjects."""
