"""Operators for preparing training text: filters, sampling, indexes, tokens, models."""
