"""Named queries over the driver tables; importing a module registers its queries."""

from __future__ import annotations

import importlib

from dataward.plans.registry import QUERIES, SQL

_MODULES = ["usage", "registries", "slo", "ledger", "snapshots", "sync", "graph", "constraints",
            "graph_rules", "text", "report", "requirements", "feeds", "streams"]


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"dataward.plans.{m}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_sql():
    _load()
    return dict(SQL)
