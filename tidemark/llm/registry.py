"""Queries of this subpackage, each with its SQL twin where SQL can say it."""

QUERIES: dict = {}
TWINS: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            TWINS[name] = sql
        return fn
    return add
