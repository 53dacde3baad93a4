"""Arbora: graph, vector and text analytics over DataFrames."""

__version__ = "0.1.0"
