"""Registry of the core queries: name -> (Spark callable, oracle SQL or None)."""

from __future__ import annotations

import importlib

#: Modules of this package that export ``QUERIES``.
FAMILIES = ("corpus", "tokens", "chat", "tasks", "evals", "series", "packing", "reports", "relational", "evaluation", "streams")


def _all() -> dict:
    out: dict = {}
    for family in FAMILIES:
        module = importlib.import_module(f"quern.plans.{family}")
        clash = out.keys() & module.QUERIES.keys()
        if clash:
            raise ValueError(f"query names used twice: {sorted(clash)}")
        out |= module.QUERIES
    return out


def queries() -> dict:
    return {name: pair[0] for name, pair in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: pair[1] for name, pair in _all().items() if pair[1]}
