"""All registered queries of the core, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = ("problems", "exact", "graphs", "texts", "rewrites", "contexts", "people", "standing", "inputs")


def _collect(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"lodeline.plans.{name}"), what)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out |= part
    return out


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict:
    return _collect("ORACLE")
