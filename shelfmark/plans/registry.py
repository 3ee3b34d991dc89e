"""Registered queries: a name, a DataFrame function over (spark, sf_dir), and its SQL twin where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    """Registers the function under its name; ``views`` are CTEs put before the SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = ("WITH " + ",\n".join(v.strip() for v in views) + "\n" if views else "") + sql.strip()
        return f

    return add
