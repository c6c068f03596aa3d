"""All ready-made queries by name, each with the SQL text of its expected result."""

from __future__ import annotations

from . import analysis_queries, live_queries, log_queries, source_queries, table_queries

QUERIES = {**source_queries.QUERIES, **log_queries.QUERIES, **analysis_queries.QUERIES, **live_queries.QUERIES, **table_queries.QUERIES}


def queries():
    return {name: run for name, (run, _) in QUERIES.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in QUERIES.items() if sql is not None}
