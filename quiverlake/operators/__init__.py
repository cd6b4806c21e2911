"""Relational operators over the context tables."""
