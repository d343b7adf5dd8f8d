"""Operators for preparing training text: extraction, deduplication, filtering, scoring and mixing."""
