"""Readers and writers for formats Spark does not bring along."""
