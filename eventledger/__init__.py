"""Event ledger: ingest, store and query bus events with PySpark."""

__version__ = "0.1.0"
