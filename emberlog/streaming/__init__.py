"""Structured Streaming forms of the keyed rules."""
