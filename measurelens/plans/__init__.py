"""Queries over the supplied tables, each beside the SQL that checks it."""

from __future__ import annotations

import importlib

_MODULES = ("curation", "grouping", "panels", "landscape", "claims", "scoring", "partitions", "modelling", "validation")


def load():
    """(queries, SQL by query name)."""
    from measurelens.plans import registry

    for name in _MODULES:
        importlib.import_module(f"measurelens.plans.{name}")
    return registry.QUERIES, registry.ORACLES
