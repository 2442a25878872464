"""Operators for preparing training text: scoring, counting, deduplication, sharding, mixing, encoding."""
