"""Where queries over the test tables and the SQL for the same rows are listed."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Register a function under its name, with its SQL (None where SQL cannot say it)."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add
