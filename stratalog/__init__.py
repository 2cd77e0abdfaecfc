"""Snapshot analytics over versioned columnar tables, expressed as Spark plans."""

__version__ = "0.1.0"
