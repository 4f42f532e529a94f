"""Structured Streaming forms of the weekly operators."""
