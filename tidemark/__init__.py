"""Tidemark: DataFrame operators for text, social, web, graph and positional data on Spark."""

__version__ = "0.1.0"
