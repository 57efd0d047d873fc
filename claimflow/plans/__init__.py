"""Batch plan: the phases in order."""
