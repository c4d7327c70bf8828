"""Structured Streaming runs of extraction."""
