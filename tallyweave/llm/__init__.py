"""Operators on training text: searches, filters, deduplication, encoding and mixing."""
