"""Structured Streaming forms of the cleaning and monitoring operators."""
