"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from capsight.llm import (
    chat_queries,
    code_queries,
    decontam_queries,
    dedup_queries,
    filter_queries,
    langid_queries,
    lm_queries,
    mixing_queries,
    pii_queries,
    search_queries,
    secret_queries,
    syncmer_queries,
    toxicity_queries,
)

MODULES = (
    dedup_queries, secret_queries, toxicity_queries, decontam_queries, pii_queries, lm_queries, chat_queries,
    syncmer_queries, mixing_queries, langid_queries, filter_queries, code_queries, search_queries,
)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
