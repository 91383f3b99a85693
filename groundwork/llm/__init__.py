"""Operators that prepare training data: deduplication, filters, tokenisation, packing, media."""
