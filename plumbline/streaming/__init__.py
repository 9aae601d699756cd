"""Structured Streaming forms of the drift check."""
