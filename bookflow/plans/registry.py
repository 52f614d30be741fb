"""All queries of the library by name, and their SQL where SQL can express them."""

from __future__ import annotations

from bookflow.plans import book_queries, page_queries, service_queries, settings_queries, text_queries

MODULES = (text_queries, page_queries, settings_queries, book_queries, service_queries)


def queries():
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
