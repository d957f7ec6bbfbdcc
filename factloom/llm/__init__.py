"""Operators for training-data pipelines over text; nothing outside imports this package."""
