"""Readers and writers: shared file system, raw vectors, logs, segments, catalog."""
