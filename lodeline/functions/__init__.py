"""Scalar functions as Catalyst columns, and the few Arrow functions that need Python."""
