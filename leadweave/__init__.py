"""Outcome analytics over lead and event tables, expressed as Spark DataFrames."""

__version__ = "0.1.0"
