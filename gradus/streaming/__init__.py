"""Structured Streaming forms of the incremental reports."""
