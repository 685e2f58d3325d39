"""All registered queries."""
from __future__ import annotations

from importlib import import_module

GROUPS = ("ingest", "policy", "events", "features", "cadence", "evaluation", "survival", "schedule", "models", "seeded")


def _catalogs():
    return [import_module(f"rebuyflow.catalog.{name}").catalog for name in GROUPS]


def all_queries() -> dict:
    return {name: fn for catalog in _catalogs() for name, fn in catalog.queries.items()}


def all_oracles() -> dict:
    return {name: sql for catalog in _catalogs() for name, sql in catalog.oracles.items()}
