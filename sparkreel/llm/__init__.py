"""Operators for preparing text corpora: counts, filters, deduplication, extraction and packing."""
