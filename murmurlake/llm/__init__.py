"""Operators for preparing training text: counting, cleaning, deduplicating, scoring and packing documents."""
