"""Operators for large training-text corpora, and their registered queries."""
