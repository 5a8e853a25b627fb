"""Registered queries over the driver's tables, each next to its SQL oracle."""

from __future__ import annotations

from importlib import import_module

MODULES = ("cleaning", "adoption", "series", "forecasts", "reconciliation", "joining", "tables")


def load_all():
    """Import every query module and return (queries, oracles)."""
    from uptake.workloads.registry import ORACLES, QUERIES

    for name in MODULES:
        import_module(f"uptake.workloads.{name}")
    return QUERIES, ORACLES
