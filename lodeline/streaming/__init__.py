"""Structured Streaming companions of the batch operators."""
