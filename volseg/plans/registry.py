"""All queries of the core, by name."""

from __future__ import annotations

from volseg.plans import segments, tables, volume

MODULES = (volume, segments, tables)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
