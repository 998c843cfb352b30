"""Operators of a training-data pipeline over document, vector and chat tables."""
