"""Operators for training-data pipelines; nothing else in docloom imports this package."""
