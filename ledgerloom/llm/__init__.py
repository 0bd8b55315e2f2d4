"""Operators and queries of a training-data pipeline over tables of documents."""
