"""Operators for preparing training data: filtering, deduplication, extraction, packing."""
