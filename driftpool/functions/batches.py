"""Rows of one key within an Arrow batch."""

import numpy as np
import pyarrow as pa


def same(a: tuple, b: tuple) -> bool:
    """Equal keys; missing numbers equal each other."""
    return all(x == y or (x != x and y != y) for x, y in zip(a, b))


def groups(batch: pa.RecordBatch, keys: list[str]):
    """``(key, row numbers)`` of every key of the batch, rows in the batch's order; nulls are a key of their own."""
    rows = batch.num_rows
    if not rows:
        return
    code = np.zeros(rows, dtype=np.int64)
    for k in keys:
        column = batch.column(k).dictionary_encode(null_encoding="encode")
        code = code * max(len(column.dictionary), 1) + column.indices.to_numpy(zero_copy_only=False)
        code = np.unique(code, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(code[order]) > 0))
    names = batch.select(keys).take(pa.array(order[starts])).to_pylist() if keys else [{}]
    for name, part in zip(names, np.split(order, starts[1:])):
        yield tuple(name[k] for k in keys), part


def matrix(batch: pa.RecordBatch, column: str, dtype) -> np.ndarray:
    """A list column whose lists are equally long, as rows of a matrix."""
    lists = batch.column(column)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(batch.num_rows, -1)
