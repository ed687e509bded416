"""Incremental processing of committed batches with Structured Streaming."""
