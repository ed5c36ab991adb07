"""Registered queries and the SQL they are checked against."""
from __future__ import annotations

import importlib

MODULES = ("preparation", "forecasts", "comparisons", "bands", "monitoring", "evidence", "learning")


def load():
    from tidepanel.catalog import kit

    for name in MODULES:
        importlib.import_module(f"tidepanel.catalog.{name}")
    return kit.QUERIES, kit.ORACLES
