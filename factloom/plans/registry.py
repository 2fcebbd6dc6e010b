"""Where registered queries and their SQL are kept."""

from __future__ import annotations

from factloom.sources.stage import table

__all__ = ["ORACLES", "QUERIES", "query", "table"]
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep

