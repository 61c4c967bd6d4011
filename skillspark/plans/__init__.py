"""Queries over the project's tables, with their oracle SQL."""
