"""Broadcast only what has been measured, and keep in a worker only what its operator needs."""

import ctypes
import gc

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, functions as F

from driftpool.session import staged

MAX_BYTES = 16 << 20

BATCH_ROWS = 1000

_stores = {}


def narrow(spark) -> None:
    """Hand whole texts to Python workers at most BATCH_ROWS at a time, from here on in this session."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def worker_store(operator: str) -> dict:
    """What this Python process keeps for an operator. Spark reuses its workers: what others kept there is dropped."""
    others = [name for name in _stores if name != operator]
    for name in others:
        del _stores[name]
    if others:
        _give_back()
    return _stores.setdefault(operator, {})


def _give_back():
    # freed memory stays with the process until the allocators are told to return it
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)     # glibc only
    if trim:
        trim(0)


class Grown:
    """A numpy array that is appended to."""

    def __init__(self, kind):
        self.data, self.size = np.zeros(1 << 12, kind), 0

    def add(self, values):
        need = self.size + len(values)
        if need > len(self.data):
            self.data = np.append(self.data, np.zeros(max(need, 3 * len(self.data) // 2) - len(self.data), self.data.dtype))
        self.data[self.size:need] = values
        self.size = need


class Numbered(dict):
    """Numbers of words in the order they are first asked for; ``fresh`` lists those that nobody has dealt with."""

    def __init__(self):
        super().__init__()
        self.fresh = []

    def __missing__(self, word):
        number = self[word] = len(self)
        self.fresh.append(word)
        return number


def measured(df: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Stage ``df`` and hint a broadcast only if its rows, counted in bytes, are within ``max_bytes``.

    Beyond that the joins it takes part in are shuffled, which Spark may split where a key is hot.
    """
    kept = staged(df)
    row = F.lit(0)
    for name, kind in kept.dtypes:
        row = row + (F.coalesce(F.octet_length(name), F.lit(0)) if kind in ("string", "binary") else F.lit(16))
    size = kept.agg(F.sum(row.cast("bigint"))).first()[0] or 0
    return F.broadcast(kept) if size <= max_bytes else kept
