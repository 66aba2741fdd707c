"""Operators for building training corpora: scoring, filtering, deduplication and packing."""
