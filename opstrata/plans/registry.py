"""Queries registered with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def registry() -> tuple[dict[str, Query], dict[str, str], Callable]:
    """(queries, SQL by name, decorator). ``query(sql, column="int")`` registers a function under its name; columns named have their SQL type set to that of the query's."""
    queries: dict[str, Query] = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None, **types: str) -> Callable[[Query], Query]:
        def register(f: Query) -> Query:
            queries[f.__name__] = f
            if sql:
                casts = ", ".join(f"cast({c} as {t}) as {c}" for c, t in types.items())
                oracles[f.__name__] = f"select * replace ({casts}) from ({sql})" if casts else sql
            return f

        return register

    return queries, oracles, query
