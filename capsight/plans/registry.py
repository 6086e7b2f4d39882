"""Registered queries and their DuckDB SQL, gathered from the modules of this package."""

from __future__ import annotations

from capsight.plans import decisions, events, imports, ordered, packets, protocols, quality, retrieval, store, streams, tasks, wire

MODULES = (events, packets, protocols, ordered, retrieval, quality, tasks, wire, streams, imports, decisions, store)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
