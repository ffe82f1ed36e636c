"""What the query modules share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def registry():
    """Two empty tables, of queries and of SQL, and the decorator that fills them."""
    queries: dict = {}
    sql: dict = {}

    def query(name: str, text: str | None = None):
        def add(f):
            queries[name] = f
            if text is not None:
                sql[name] = text
            return f

        return add

    return queries, sql, query


def rounded(name: str, digits: int = 6) -> Column:
    """A column for comparison: rounded, and zero without a sign."""
    return (F.round(F.col(name), digits) + 0.0).alias(name)


def r(expr: str, name: str, digits: int = 6) -> str:
    """The same in SQL."""
    return f'round({expr}, {digits}) + 0.0 AS "{name}"'
