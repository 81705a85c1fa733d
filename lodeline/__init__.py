"""Provenance-aware retrieval, graph and history analytics on Apache Spark."""

__version__ = "0.1.0"
