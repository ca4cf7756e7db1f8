"""Catalog building, filtered vector retrieval and release checks as Spark DataFrame jobs."""

__version__ = "0.1.0"
