"""Structured Streaming: when an index is due, and keeping it up to date."""
