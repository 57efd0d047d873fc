"""Scans: landing folders, bronze table, gold records, prompt files, object listings."""
