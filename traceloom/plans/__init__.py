"""Registered queries: each pairs a plan over the given tables with SQL that must agree.

``registry()`` imports the query modules and returns name -> (callable, SQL or None).
"""

from __future__ import annotations

from importlib import import_module

MODULES = ("traces", "curation", "outcomes", "routing", "studies", "workflow", "learning")


def registry() -> dict:
    from traceloom.plans.base import QUERIES

    for name in MODULES:
        import_module(f"traceloom.plans.{name}")
    return QUERIES
