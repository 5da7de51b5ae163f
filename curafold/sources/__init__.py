"""Readers, writers, run summaries and file integrity."""
