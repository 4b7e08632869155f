"""Structured Streaming forms of the event aggregates."""
