"""Structured Streaming versions of the row-wise plans."""
