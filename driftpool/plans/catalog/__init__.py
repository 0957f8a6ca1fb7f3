"""Registered queries: name -> Spark callable, and the same result as plain SQL."""

import importlib

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def keep(run):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run
    return keep


def load() -> None:
    for part in ("streams", "accuracy", "features", "models", "pools", "similarity", "loops", "exchanges"):
        importlib.import_module(f"{__name__}.{part}")
