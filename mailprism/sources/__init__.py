"""Readers and writers: message bus, files, verdict table, models and metrics."""
