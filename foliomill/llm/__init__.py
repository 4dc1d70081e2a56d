"""Operators for preparing training data: filtering, deduplication, tokens and packing."""
