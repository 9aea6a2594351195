"""Structured Streaming forms of the bar-by-bar work."""
