"""Structured Streaming upserts and incremental reads."""
