"""Structured Streaming forms of the sources and aggregates."""
