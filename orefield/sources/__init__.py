"""Readers of markup and provider records into plain tables."""
