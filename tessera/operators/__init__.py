"""Relational operators: search, mutation logs, approximate indexes, embedding."""
