"""Run a registered query and its SQL side by side."""

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(frame):
    frame = frame[sorted(frame.columns)]
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, list):
            return tuple(cell(x) for x in v)
        return v
    rows = [tuple(cell(v) for v in row) for row in frame.astype(object).itertuples(index=False)]
    return sorted(rows, key=lambda row: tuple((x is None, str(x)) for x in row))


def kind(t):
    t = t.lower()
    for spark, duck in (("bigint", "bigint"), ("int", "integer"), ("string", "varchar"), ("double", "double")):
        if t == spark or t == duck:
            return duck
    return t


def compare(spark, run, sql, con, folder):
    """Empty string if both sides agree, else what differs."""
    result = run(spark, folder)
    left = result.toPandas()
    rel = con.sql(sql)
    right = rel.df()
    types = dict(zip(rel.columns, [kind(str(t)) for t in rel.types]))
    mine = {n: kind(t) for n, t in result.dtypes}
    if types != mine:
        return f"schema {mine} / {types}"
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    a, b = _plain(left), _plain(right)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}"
    return "" if len(a) else "both empty"
