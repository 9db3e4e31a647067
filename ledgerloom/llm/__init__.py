"""Operators for large text corpora: deduplication, screening, scoring, encoding."""
