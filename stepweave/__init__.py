"""Spark DataFrame operators over episode-step tables."""

__version__ = "0.1.0"
