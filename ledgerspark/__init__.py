"""Spark-native ledger ingest, audit query and rule engine."""

__version__ = "0.1.0"
