"""Structured Streaming forms of the row-wise and log operators."""
