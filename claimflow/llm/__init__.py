"""Operators for building training data from large corpora. Nothing outside this package imports it."""
