"""Structured Streaming forms of the request-driven state."""
