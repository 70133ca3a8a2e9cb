"""Structured Streaming state machines."""
