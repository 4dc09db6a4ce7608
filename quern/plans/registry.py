"""All queries of the core by name, and their SQL."""

from __future__ import annotations

from quern.plans import answering, catalog, compiled, core, facts, packs

MODULES = (core, packs, facts, catalog, compiled, answering)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
