"""Structured Streaming forms of scoring, aggregation and verdicts."""
