"""Continuous ingestion and metrics."""
