"""Operators for preparing large text corpora: filters, scans, deduplication, tokens, packing and search."""
