"""Readers of recorded experiments, and reports over their tables."""
