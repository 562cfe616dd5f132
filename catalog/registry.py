from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Catalog:
    """Named queries, each with the SQL that gives the same rows."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def register(run):
            self.queries[name] = run
            if sql:
                self.sql[name] = sql
            return run

        return register
