"""Streaming forms of the state machines."""
