"""Queries over the test tables, each with its DuckDB twin where SQL can say it."""

from catalog import event_queries, metric_queries, row_queries, sequence_queries, table_queries, text_queries

MODULES = (table_queries, event_queries, sequence_queries, row_queries, text_queries, metric_queries)


def queries():
    return {name: run for module in MODULES for name, run in module.CATALOG.queries.items()}


def oracle_sql():
    return {name: sql for module in MODULES for name, sql in module.CATALOG.sql.items()}
