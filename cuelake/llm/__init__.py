"""Operators of a training-data pipeline over document, page, label and vector tables."""
