"""Operators for preparing training corpora: deduplication, filters, mixing, token files."""
