"""Structured Streaming operators with keyed state."""
