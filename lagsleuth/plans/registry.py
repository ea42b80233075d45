"""Named queries: each pairs a Spark plan over the given tables with its check SQL, if there is one."""
from __future__ import annotations

QUERIES: dict[str, tuple] = {}


def query(op: str, name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = (fn, sql, op)
        return fn
    return add
