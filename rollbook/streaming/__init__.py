"""Structured Streaming forms of the same operators."""
