"""Structured Streaming forms of the usage operators."""
