"""Queries over the given tables, and SQL that states the same for comparison."""
