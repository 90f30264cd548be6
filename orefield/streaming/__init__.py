"""Streaming forms of the event and job operators."""
