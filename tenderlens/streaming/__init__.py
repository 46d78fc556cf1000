"""Incremental tender sync as Structured Streaming micro-batches."""
