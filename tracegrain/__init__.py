"""Spark-first code-risk analytics."""

__version__ = "0.1.0"
