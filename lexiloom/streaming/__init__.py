"""Structured Streaming forms of the stateful jobs."""
