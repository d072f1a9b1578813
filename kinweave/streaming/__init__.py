"""Incremental linking."""
