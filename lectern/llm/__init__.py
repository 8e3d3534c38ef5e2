"""Operators for training-data pipelines over document, page, vector and media tables."""
