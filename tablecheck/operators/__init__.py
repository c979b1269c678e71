"""Comparison, integrity, alignment and purge operators."""
