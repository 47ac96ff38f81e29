"""Operators for large training corpora."""
