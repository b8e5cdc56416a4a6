"""Structured Streaming twins of the table operators."""
