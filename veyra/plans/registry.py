"""Queries by name, each beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from veyra.sources.tables import Tables

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of ``Tables`` as a query of (spark, folder), with its SQL if SQL can say it."""

    def wrap(f: Callable[[Tables], DataFrame]):
        def run(spark, folder):
            return f(Tables(spark, folder))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return wrap
