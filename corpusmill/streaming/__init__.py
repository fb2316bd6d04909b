"""Structured Streaming forms of the byte statistics."""
