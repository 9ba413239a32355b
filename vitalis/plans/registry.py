"""All queries of the core by name, with the SQL that states the same."""

from __future__ import annotations

from vitalis.plans import lake, process, records, trends, warehouse

_MODULES = (process, trends, warehouse, records, lake)
QUERIES: dict = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL: dict[str, str] = {name: s for m in _MODULES for name, s in m.SQL.items()}
FLAGSHIP = "q03_process_by_org"
