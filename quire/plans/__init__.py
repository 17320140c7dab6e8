"""Registered queries: one module per operator family, Spark query and SQL twin side by side."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ["sources", "sinks", "nested", "filters", "joins", "aggregates", "windows", "setops", "scalars",
            "text", "linkage", "vectors", "streaming"]


def load() -> dict:
    from quire.plans.registry import CATALOG
    for family in FAMILIES:
        import_module(f"quire.plans.{family}_queries")
    return CATALOG
