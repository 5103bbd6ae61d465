"""Operators for preparing training data: sharding, filters, deduplication, search, encoding, mixing."""
