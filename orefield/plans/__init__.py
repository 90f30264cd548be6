"""Queries over the driver's tables, each with SQL for the same rows."""
