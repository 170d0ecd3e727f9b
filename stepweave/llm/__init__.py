"""Operators of a training-data pipeline over whole text corpora. Nothing else of the library imports this package."""
