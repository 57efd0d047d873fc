"""Continuous ingestion, duplicate suppression and running counts."""
