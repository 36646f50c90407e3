"""Operators for pipelines of training data; nothing outside imports this."""
