"""Vellum: book-scale text processing and analytics as PySpark DataFrames."""

__version__ = "0.1.0"
