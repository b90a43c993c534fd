"""Structured Streaming forms of the binned operators."""
