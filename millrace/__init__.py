"""Retail order analytics on PySpark: ingestion, history, facts, marts, measures and audits."""

__version__ = "0.1.0"
