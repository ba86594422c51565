"""Mutation logs as streams."""
