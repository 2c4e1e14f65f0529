"""The registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r6(*names: str) -> list:
    return [F.round(F.col(n), 6).alias(n) for n in names]
