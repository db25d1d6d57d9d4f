"""Queries over the driver tables, each with a SQL twin where one exists."""

from __future__ import annotations

from importlib import import_module

from pollgauge.plans.catalog import REGISTRY, Query

MODULES = ("archive", "windows", "faults", "reports", "statistics", "streams", "assistant")


def load_queries() -> dict[str, Query]:
    for name in MODULES:
        import_module(f"pollgauge.plans.{name}")
    return dict(REGISTRY)
