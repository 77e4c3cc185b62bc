"""Where queries are registered under their names, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from episodica.plans.prelude import PRELUDE

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        own = not sql.startswith("SELECT")  # begins with tables of its own
        _QUERIES[f.__name__], _SQL[f.__name__] = f, f"WITH RECURSIVE {PRELUDE}{', ' if own else ' '}{sql}"
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
