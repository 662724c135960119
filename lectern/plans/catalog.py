"""All queries of the library's core: name to plan, and name to the SQL it is compared with."""

from __future__ import annotations

from lectern.plans import analytics, files, integrity, papers, records

MODULES = [analytics, papers, records, integrity, files]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
