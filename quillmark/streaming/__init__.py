"""Incremental processing with Structured Streaming."""
