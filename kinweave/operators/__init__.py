"""Operators on records, pairs and links."""
