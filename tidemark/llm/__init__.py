"""Operators for building training corpora: counts, de-duplication, filters, scores, mixing, search and encoding."""
