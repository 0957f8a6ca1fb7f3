"""Registered queries of this subpackage: name -> Spark callable, and the same result as plain SQL."""

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


from driftpool.llm import queries  # noqa: E402, F401
