"""Queries registered for checking, each over the whole given tables, and their SQL twins."""
