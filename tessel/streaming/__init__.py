"""Incremental (Structured Streaming) forms of the row-level jobs."""
