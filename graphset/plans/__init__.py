"""Data sets and queries over the given tables."""
