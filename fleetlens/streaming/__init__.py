"""Structured Streaming versions of the log, counter and sample jobs."""
