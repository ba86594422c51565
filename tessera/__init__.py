"""Tessera: named vector collections and exact similarity search on Spark."""

__version__ = "0.1.0"
