"""Least-squares fits for every group at once, from mergeable sums."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from driftpool.functions import batches, linalg

PARTIAL_BYTES = 64 << 20
SALTS = 64


def moments(df: DataFrame, keys: list[str], xs: list[str], y: str) -> DataFrame:
    """One row per group: n, sum x, sum y, X'X (upper triangle by rows), X'y, y'y.

    Plain sums, so Spark combines them before the shuffle and a hot group
    costs one row per map task.
    """
    f = [F.col(x) for x in xs]
    t = F.col(y)
    upper = [f[i] * f[j] for i in range(len(f)) for j in range(i, len(f))]
    sums = ([("n", F.count(t))] + [(f"_s{i}", F.sum(c)) for i, c in enumerate(f)]
            + [("sy", F.sum(t)), ("yy", F.sum(t * t))]
            + [(f"_q{i}", F.sum(c)) for i, c in enumerate(upper)]
            + [(f"_t{i}", F.sum(c * t)) for i, c in enumerate(f)])
    flat = df.groupBy(*keys).agg(*[c.alias(n) for n, c in sums])
    return flat.select(
        *keys, F.col("n").cast("bigint").alias("n"), "sy", "yy",
        F.array(*[f"_s{i}" for i in range(len(f))]).alias("sx"),
        F.array(*[f"_q{i}" for i in range(len(upper))]).alias("xx"),
        F.array(*[f"_t{i}" for i in range(len(f))]).alias("xy"))


def _added(one, two):
    """Moments of two disjoint sets of rows together."""
    n, mean, products = one
    more, other, extra = two
    total = n + more
    step = other - mean
    return total, mean + step * (more / total), products + extra + np.outer(step, step) * (n * more / total)


def _rows_of(held, keys: list[str], schema: pa.Schema) -> pa.RecordBatch:
    columns = [[k[i] for k, _ in held] for i in range(len(keys))]
    columns += [[v[0] for _, v in held], [v[1] for _, v in held],
                [v[2][np.triu_indices(len(v[1]))] for _, v in held]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _partial(keys: list[str], schema: pa.Schema, limit: int):
    """Moments of a task's rows, one row per key; beyond ``limit`` bytes they are handed on and begun anew."""
    def run(source):
        held, size = {}, 0
        for batch in source:
            values = batches.matrix(batch, "_v", float) if batch.num_rows else None
            for key, rows in batches.groups(batch, keys):
                v = values[rows]
                mean = v.mean(axis=0)
                d = v - mean
                new = (len(rows), mean, d.T @ d)
                size += 0 if key in held else new[2].nbytes + 512
                held[key] = _added(held[key], new) if key in held else new
            if size > limit:
                yield _rows_of(list(held.items()), keys, schema)
                held, size = {}, 0
        if held:
            yield _rows_of(list(held.items()), keys, schema)
    return run


def _merged(keys: list[str], schema: pa.Schema, limit: int):
    """Rows of equal key that follow each other, added up; only one key is open at a time."""
    def run(source):
        current, total, done, size = None, None, [], 0
        for batch in source:
            for i in range(batch.num_rows):
                key = tuple(batch.column(k)[i].as_py() for k in keys)
                mean = np.asarray(batch.column("mean")[i].values)
                products = np.zeros((len(mean), len(mean)))
                products[np.triu_indices(len(mean))] = np.asarray(batch.column("products")[i].values)
                products += np.triu(products, 1).T
                new = (batch.column("n")[i].as_py(), mean, products)
                if current is not None and batches.same(current, key):
                    total = _added(total, new)
                    continue
                if current is not None:
                    done.append((current, total))
                    size += total[2].nbytes + 512
                    if size > limit:
                        yield _rows_of(done, keys, schema)
                        done, size = [], 0
                current, total = key, new
        if current is not None:
            done.append((current, total))
            yield _rows_of(done, keys, schema)
    return run


def centred(df: DataFrame, keys: list[str], xs: list[str], y: str, limit: int = PARTIAL_BYTES) -> DataFrame:
    """One row per group: ``n``, ``mean`` of features and label, upper triangle of their centred ``products``.

    Each task sums up its rows around their own mean, batch by batch, and
    sends one row per group; two rounds of adding rows up (first by group and
    salt) follow, each with one group open at a time. Offsets of a feature
    cancel nothing, the plan is equally short for any number of features, and
    a hot group costs one row per task. Rows in which a feature or the label
    is missing are left out; a group without any other has no row.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    fields = [df.schema[k] for k in keys]
    out = T.StructType(fields + [T.StructField("n", T.LongType()), T.StructField("mean", T.ArrayType(T.DoubleType())),
                                 T.StructField("products", T.ArrayType(T.DoubleType()))])
    schema = to_arrow_schema(out)
    values = F.array(*[F.col(c).cast("double") for c in [*xs, y]])
    rows = df.select(*keys, values.alias("_v")).filter(F.forall("_v", lambda v: v.isNotNull()))
    parts = rows.mapInArrow(_partial(keys, schema, limit), out).withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    salted = T.StructType([*out.fields, T.StructField("_salt", T.IntegerType())])
    first = (parts.repartition(*keys, "_salt").sortWithinPartitions(*keys, "_salt")
             .mapInArrow(_merged([*keys, "_salt"], to_arrow_schema(_order(salted, [*keys, "_salt"])), limit),
                         _order(salted, [*keys, "_salt"])))
    whole = first.repartition(*keys).sortWithinPartitions(*keys) if keys else first.coalesce(1)
    return whole.mapInArrow(_merged(keys, schema, limit), out)


def _order(schema: T.StructType, keys: list[str]) -> T.StructType:
    names = keys + [n for n in schema.names if n not in keys]
    return T.StructType([schema[n] for n in names])


def of_centred(n, mean, products) -> linalg.CentredMoments:
    mean = np.asarray(mean, dtype=float)
    full = np.zeros((len(mean), len(mean)))
    full[np.triu_indices(len(mean))] = np.asarray(products, dtype=float)
    return linalg.CentredMoments(float(n), mean, full + np.triu(full, 1).T)


def unpack(n, sx, sy, xx, xy, yy) -> linalg.Moments:
    sx = np.asarray(sx, dtype=float)
    p = len(sx)
    full = np.zeros((p, p))
    full[np.triu_indices(p)] = np.asarray(xx, dtype=float)
    full = full + np.triu(full, 1).T
    return linalg.Moments(float(n), sx, float(sy), full, np.asarray(xy, dtype=float), float(yy))


def _solver(solve):
    @F.pandas_udf("coef array<double>, intercept double, r2 double")
    def run(n: pd.Series, mean: pd.Series, products: pd.Series) -> pd.DataFrame:
        out = []
        for values in zip(n, mean, products):
            m = of_centred(*values)
            w, b = solve(m)
            w = np.asarray(w, dtype=float)
            out.append((w.tolist(), float(b), m.r2(w, float(b))))
        return pd.DataFrame(out, columns=["coef", "intercept", "r2"])
    return run


def solved(stats: DataFrame, method: str = "ols", alpha: float = 1.0, l1: float = 0.5,
           positive: bool = False) -> DataFrame:
    """Turn rows of ``centred`` into ``coef``, ``intercept`` and the fit's ``r2`` on its own rows."""
    ways = {
        "ols": lambda m: linalg.ols(m),
        "ridge": lambda m: linalg.ridge(m, alpha),
        "kernel_ridge": lambda m: linalg.kernel_ridge(m, alpha),
        "elastic": lambda m: linalg.elastic(m, alpha, l1, positive),
        "non_negative": lambda m: linalg.non_negative(m),
    }
    fit = _solver(ways[method])
    return (stats.withColumn("_fit", fit("n", "mean", "products"))
            .select(*stats.columns, F.col("_fit.coef").alias("coef"),
                    F.col("_fit.intercept").alias("intercept"), F.col("_fit.r2").alias("r2")))


def fit(df: DataFrame, keys: list[str], xs: list[str], y: str, method: str = "ols", r2: bool = False,
        **settings) -> DataFrame:
    """Coefficients of every group; ``r2`` adds the share of the label's spread they explain."""
    shown = ["n", "coef", "intercept"] + (["r2"] if r2 else [])
    return solved(centred(df, keys, xs, y), method, **settings).select(*keys, *shown)


def fourier(features: list[Column], size: int, gamma: float, seed: int) -> list[Column]:
    """Random Fourier features of an RBF kernel: seeded projections as columns."""
    source = np.random.default_rng(seed)
    w = source.normal(0.0, np.sqrt(2.0 * gamma), (size, len(features)))
    b = source.uniform(0.0, 2.0 * np.pi, size)
    out = []
    for i in range(size):
        angle = F.lit(float(b[i]))
        for j, f in enumerate(features):
            angle = angle + f * float(w[i, j])
        out.append(F.cos(angle) * float(np.sqrt(2.0 / size)))
    return out


def components(df: DataFrame, keys: list[str], xs: list[str], y: str, left_out: float) -> DataFrame:
    """Principal directions of each group's features and label: ``pcs`` by columns."""
    @F.pandas_udf("array<array<double>>")
    def directions(n: pd.Series, mean: pd.Series, products: pd.Series) -> pd.Series:
        return pd.Series([linalg.components(of_centred(*v), left_out).T.tolist() for v in zip(n, mean, products)])
    stats = centred(df, keys, xs, y)
    return stats.select(*keys, "n", directions("n", "mean", "products").alias("pcs"))
