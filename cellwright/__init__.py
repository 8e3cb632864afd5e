"""Cellwright: documents and delimited data to typed, source-traced tables, as lazy Spark plans."""

__version__ = "0.1.0"
