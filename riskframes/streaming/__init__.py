"""Structured Streaming forms of the event-ordered operators."""
