"""A query is a callable ``(spark, sf_dir) -> DataFrame``, with its SQL twin when SQL can say it."""

QUERIES: dict = {}
TWINS: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            TWINS[name] = sql
        return fn
    return add
