"""Operators on large text and vector corpora."""
