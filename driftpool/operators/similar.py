"""How alike models are: distances, local scales, affinities, shared information, clusters.

Pairs are pairs of models of one pool, never of rows: what is paired has been
aggregated before. A pool larger than ``MAX_POOL`` is never packed into one row.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from driftpool.functions import batches, linalg
from driftpool.session import bounded_groups, bounded_side, join_bounded, staged

MAX_POOL = 1000


def standardised(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Columns minus mean over sample deviation; constant ones are only centred.

    Means and deviations are aggregated first and looked up, so a large group
    is never sorted into one window.
    """
    stats = df.groupBy(*keys).agg(*[f(c).alias(f"_{n}_{c}") for c in columns
                                    for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    joined = join_bounded(df, stats, keys)
    def one(c):
        s = F.col(f"_s_{c}")
        return ((F.col(c) - F.col(f"_m_{c}")) / F.when(s > 0, s).otherwise(1.0)).alias(c)
    others = [c for c in df.columns if c not in columns]
    return joined.select(*others, *[one(c) for c in columns])


def packed(models: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per pool: ids and values in id order."""
    both = F.array_sort(F.collect_list(F.struct("model_id", value)))
    models = bounded_groups(models.select(*keys, "model_id", value), keys, MAX_POOL)
    rows = models.groupBy(*keys).agg(both.alias("_m"))
    return rows.select(*keys, F.col("_m.model_id").alias("ids"), F.col(f"_m.{value}").alias(value))


def pairs_of(models: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``i < j`` of one pool with their values ``a`` and ``b``, one row a pair.

    The pool is joined to itself, with its rows spread over salts where it is too large to broadcast, so a pool
    has no limit and its pairs are worked on by many tasks.
    """
    left = models.select(*keys, F.col("model_id").alias("i"), F.col(value).alias("a"))
    right = models.select(*keys, F.col("model_id").alias("j"), F.col(value).alias("b"))
    return join_bounded(left, right, keys).filter("i < j")


def distance_pairs(models: DataFrame, keys: list[str], value: str, metric) -> DataFrame:
    """Distance of every pair of a pool's models under an own function ``metric(a, b) -> float`` of their values."""
    @F.pandas_udf("double")
    def distances(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([float(metric(x, y)) for x, y in zip(a, b)], dtype="float64")
    return pairs_of(models, keys, value).select(*keys, "i", "j", distances("a", "b").alias("d"))


def _angle(a, b) -> float:
    return linalg.angle_distance(np.array([list(c) for c in a]).T, np.array([list(c) for c in b]).T)


def angle_pairs(models: DataFrame, keys: list[str]) -> DataFrame:
    """Principal-angle distance of every pair of a pool's models (column ``pcs``)."""
    return distance_pairs(models, keys, "pcs", _angle)


def angle_pairs_with(new: DataFrame, models: DataFrame, keys: list[str]) -> DataFrame:
    """Only the pairs of one new model per pool with the models already there."""
    @F.pandas_udf("double")
    def distances(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_angle(x, y) for x, y in zip(a, b)], dtype="float64")
    there = models.select(*keys, F.col("model_id").alias("j"), F.col("pcs").alias("b"))
    added = new.select(*keys, F.col("model_id").alias("i"), F.col("pcs").alias("a"))
    both = join_bounded(there, added, keys).filter("i <> j")
    return both.select(*keys, "i", "j", distances("a", "b").alias("d"))


def vector_pairs(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Euclidean distance of every pair of a pool's vectors, inside the JVM."""
    square = F.aggregate(F.zip_with("a", "b", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v)
    return pairs_of(vectors, keys, "vector").select(*keys, "i", "j", F.sqrt(square).alias("d"))


def prediction_pairs(stats: DataFrame, keys: list[str], ids: list[str]) -> DataFrame:
    """Euclidean distance of prediction vectors from the moments of the predictions."""
    m = len(ids)
    at = {}
    for i in range(m):
        for j in range(i, m):
            at[i, j] = len(at)
    cell = lambda i, j: F.col("xx")[at[i, j]]
    listed = [F.struct(F.lit(ids[i]).alias("i"), F.lit(ids[j]).alias("j"),
                       F.sqrt(F.greatest(cell(i, i) + cell(j, j) - 2 * cell(i, j), F.lit(0.0))).alias("d"))
              for i in range(m) for j in range(i + 1, m)]
    return stats.select(*keys, F.explode(F.array(*listed)).alias("_p")).select(*keys, "_p.*")


def both_ways(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Each distance seen from both models."""
    flipped = pairs.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), "d")
    return pairs.select(*keys, "i", "j", "d").unionByName(flipped)


def local_scales(pairs: DataFrame, keys: list[str], k: int) -> DataFrame:
    """k-th nearest distance of each model, the own zero included.

    Zeros beyond ``k`` move the place up; a pool with too few models takes the
    farthest one.
    """
    near = both_ways(pairs, keys).groupBy(*keys, "i").agg(F.sort_array(F.collect_list("d")).alias("_d"))
    zeros = F.size(F.filter("_d", lambda d: d == 0)) + 1
    place = F.least(F.when(zeros < k, F.lit(k)).otherwise(zeros), F.size("_d"))
    return near.select(*keys, F.col("i").alias("model_id"), F.element_at("_d", place).alias("scale"))


def affinities(pairs: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Locally scaled affinity of each pair; a zero scale takes the other, two zeros count as 1."""
    scale = local_scales(pairs, keys, k)
    rows = (pairs.join(scale.select(*keys, F.col("model_id").alias("i"), F.col("scale").alias("_si")), keys + ["i"])
            .join(scale.select(*keys, F.col("model_id").alias("j"), F.col("scale").alias("_sj")), keys + ["j"]))
    si, sj = F.col("_si"), F.col("_sj")
    left = F.when((si == 0) & (sj == 0), 1.0).when(si == 0, sj).otherwise(si)
    right = F.when((si == 0) & (sj == 0), 1.0).when(sj == 0, si).otherwise(sj)
    return rows.select(*keys, "i", "j", "d", F.exp(-F.col("d") * F.col("d") / (left * right)).alias("affinity"))


def dense_rows(pairs: DataFrame, keys: list[str], value: str, diagonal: float) -> DataFrame:
    """Pair table as matrix rows in id order, for pools small enough to be clustered."""
    both = (pairs.select(*keys, "i", "j", value)
            .unionByName(pairs.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), value)))
    names = both.select(*keys, "i").distinct()
    full = both.unionByName(names.select(*keys, "i", F.col("i").alias("j"), F.lit(diagonal).alias(value)))
    rows = full.groupBy(*keys, "i").agg(F.array_sort(F.collect_list(F.struct("j", value))).alias("_r"))
    return rows.select(*keys, "i", F.col(f"_r.{value}").alias("row"))


def clusters(pairs: DataFrame, keys: list[str], most: int = 10) -> DataFrame:
    """Self-tuning spectral clusters of each pool from its affinities.

    A pool of up to ``MAX_POOL`` models is one matrix in one task; a larger one stays a pair table and only its
    leading eigenvectors are computed, see ``spread_clusters``.
    """
    kept = staged(pairs.select(*keys, "i", "j", "affinity"))
    large = kept.groupBy(*keys).count().filter(F.col("count") > MAX_POOL * (MAX_POOL - 1) // 2).select(*keys)
    if large.isEmpty():
        return _dense_clusters(kept, keys, most)
    large = staged(large)
    return _dense_clusters(kept.join(large, keys, "left_anti"), keys, most).unionByName(
        spread_clusters(kept.join(large, keys, "left_semi"), keys, most))


def _dense_clusters(pairs: DataFrame, keys: list[str], most: int) -> DataFrame:
    rows = dense_rows(pairs, keys, "affinity", 1.0).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("i", "row"))).alias("_m"))

    @F.pandas_udf("array<int>")
    def assign(matrix: pd.Series) -> pd.Series:
        return pd.Series([linalg.self_tuned_clusters(np.array([list(r) for r in m]), most).tolist() for m in matrix])

    listed = rows.select(*keys, F.arrays_zip(F.col("_m.i").alias("model_id"), assign(F.col("_m.row")).alias("cluster")).alias("_c"))
    return listed.select(*keys, F.explode("_c").alias("_c")).select(*keys, F.col("_c.model_id").alias("model_id"), F.col("_c.cluster").alias("cluster"))


def _product(weights: DataFrame, block: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Matrix of pairs times a block of vectors: a join on the column and a sum by row."""
    side, _ = bounded_side(block)
    summed = weights.join(side, keys + ["j"]).groupBy(*keys, "i").agg(
        *[F.sum(F.col("w") * F.col("v")[k]).alias(f"_{k}") for k in range(width)])
    return summed.select(*keys, F.col("i").alias("model_id"), F.array(*[f"_{k}" for k in range(width)]).alias("mw"))


def spread_clusters(pairs: DataFrame, keys: list[str], most: int = 10, guard: int = 4, limit: float = 1e-6,
                    steps: int = 500) -> DataFrame:
    """``clusters`` of pools of any size: the matrix stays a pair table, a model holds ``most + guard`` columns.

    The leading eigenvectors of the normalised affinities come from block steps: each joins the pair table to the
    residuals and sums by model, then a small problem per pool gives the next vectors, until no residual of the
    ``most`` leading ones exceeds ``limit``; not converging in ``steps`` is an error. The blocks of one pool (about
    0.5 KB a model, where its pair table has a row for each two models) meet in one task, the pairs never do.
    """
    width = most + guard
    both = pairs.select(*keys, "i", "j", "affinity").unionByName(
        pairs.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), "affinity"))
    roots = staged(both.groupBy(*keys, "i").agg(F.sqrt(F.greatest(F.sum("affinity"), F.lit(1e-300))).alias("_ri")))
    scaled = join_bounded(join_bounded(both, roots, keys + ["i"]),
                          roots.select(*keys, F.col("i").alias("j"), F.col("_ri").alias("_rj")), keys + ["j"])
    weights = staged(scaled.select(*keys, "i", "j", (F.col("affinity") / (F.col("_ri") * F.col("_rj"))).alias("w")))
    none = F.array().cast("array<double>")
    seeds = F.array(*[F.xxhash64("i", F.lit(k)) / float(1 << 63) for k in range(width)])
    blocks = ["x", "mx", "w", "p", "mp"]
    state = roots.select(*keys, F.col("i").alias("model_id"), none.alias("values"), F.lit(None).cast("double").alias("residual"),
                         *[(seeds if b == "w" else none).alias(b) for b in blocks])
    schema = state.schema
    state = staged(state)

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("model_id")
        x, mx, w, p, mp, mw = (np.stack(rows[b].to_numpy()) for b in blocks + ["mw"])
        values, *new, residual = linalg.ritz_step(x, mx, w, mw, p, mp, width)
        out = rows[[*keys, "model_id"]].copy()
        out["values"] = [values.tolist()] * len(rows)
        out["residual"] = float(residual[:most].max())
        for b, v in zip(blocks, new):
            out[b] = list(v)
        return out[schema.names]

    for _ in range(steps):
        sent = state.select(*keys, F.col("model_id").alias("j"), F.col("w").alias("v"))
        met = state.join(_product(weights, sent, keys, width), keys + ["model_id"])
        state = staged(met.groupBy(*keys).applyInPandas(step, schema))
        if (state.agg(F.max("residual")).first()[0] or 0.0) <= limit:       # one number
            break
    else:
        raise ArithmeticError(f"eigenvectors have not converged in {steps} steps")

    def assign(rows: pd.DataFrame) -> pd.DataFrame:
        found = linalg.aligned_clusters(np.array(rows["values"].iloc[0])[:most], np.stack(rows["x"].to_numpy())[:, :most])
        return rows[[*keys, "model_id"]].assign(cluster=found.astype("int32"))

    named = state.select(*keys, "model_id", "values", "x")
    return named.groupBy(*keys).applyInPandas(assign, T.StructType(
        [named.schema[k] for k in [*keys, "model_id"]] + [T.StructField("cluster", T.IntegerType())]))


def cluster_of(assigned: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Models in the same cluster as each pool's target model; the first cluster if it has none."""
    home = assigned.join(target.select(*keys, "model_id"), keys + ["model_id"]).select(*keys, F.col("cluster").alias("_home"))
    first = assigned.groupBy(*keys).agg(F.min("cluster").alias("_first"))
    wanted = first.join(home, keys, "left").select(*keys, F.coalesce("_home", "_first").alias("cluster"))
    return assigned.join(wanted, keys + ["cluster"]).select(*keys, "model_id", "cluster")


def best_of_clusters(assigned: DataFrame, scored: DataFrame, keys: list[str]) -> DataFrame:
    best = F.max_by("model_id", F.struct("r2", "model_id"))
    return assigned.join(scored, keys + ["model_id"]).groupBy(*keys, "cluster").agg(best.alias("model_id"))


def near_duplicates(pairs: DataFrame, keys: list[str], limit: float, current: DataFrame) -> DataFrame:
    """Models to prune: the later of two too similar ones, never the current model."""
    close = pairs.filter(F.col("affinity") > limit).select(*keys, F.col("j").alias("model_id")).distinct()
    return close.join(current.select(*keys, "model_id"), keys + ["model_id"], "left_anti")


def _joint_counts(keys: list[str], bins: int, schema: pa.Schema, limit: int):
    """Counts of every pair of columns' bins over a task's rows; rows wait as bin numbers up to ``limit`` bytes."""
    def counted(held):
        for key, parts in held.items():
            codes = np.concatenate(parts).T.astype(np.int64)
            for a in range(len(codes)):
                found = []
                for b in range(a, len(codes)):
                    counts = np.bincount(codes[a] * bins + codes[b], minlength=bins * bins)
                    at = np.flatnonzero(counts)
                    found.append((np.full(len(at), b), at // bins, at % bins, counts[at]))
                b, x, z, c = (np.concatenate(v) for v in zip(*found))
                columns = [[k] * len(b) for k in key] + [np.full(len(b), a), b, x, z, c]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, schema)], schema=schema)

    def run(source):
        held, size = {}, 0
        for batch in source:
            codes = batches.matrix(batch, "_b", np.int32) if batch.num_rows else None
            for key, rows in batches.groups(batch, keys):
                held.setdefault(key, []).append(codes[rows])
                size += codes[rows].nbytes
            if size > limit:
                yield from counted(held)
                held, size = {}, 0
        yield from counted(held)
    return run


def shared_information(wide: DataFrame, keys: list[str], ids: list[str], bins: int,
                       limit: int = 32 << 20) -> DataFrame:
    """``MI(a, b) / MI(b, b)`` of every ordered pair of base predictions over equal-width bins.

    Bins come from per-key ranges. Rows become bin numbers and are counted
    pair by pair inside their task, so what is shuffled are at most ``bins^2``
    counts per pair, key and ``limit`` bytes of bin numbers. A missing
    prediction counts as one in the last bin.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    m = len(ids)
    size = F.lit(bins)
    wide = staged(wide.select(*keys, *[c for c in ("seq", "preds") if c in wide.columns]))    # read for ranges and for counts
    ends = wide.groupBy(*keys).agg(*[f(F.col("preds")[i]).alias(f"_{n}{i}")
                                     for i in range(m) for n, f in (("lo", F.min), ("hi", F.max))])
    rows = join_bounded(wide, ends, keys)

    def place(i):
        lo, hi, v = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col("preds")[i]
        return F.when(hi > lo, F.least(F.floor((v - lo) / (hi - lo) * size), size - 1)).otherwise(F.lit(0)).cast("int")

    binned = rows.select(*keys, F.array(*[place(i) for i in range(m)]).alias("_b"))
    counted = T.StructType([rows.schema[k] for k in keys] + [T.StructField(n, T.IntegerType()) for n in "abxz"]
                           + [T.StructField("c", T.LongType())])
    joint = (binned.mapInArrow(_joint_counts(keys, bins, to_arrow_schema(counted), limit), counted)
             .groupBy(*keys, "a", "b", "x", "z").agg(F.sum("c").alias("c")))
    per = Window.partitionBy(*keys, "a", "b")
    n = F.sum("c").over(per)
    px = F.sum("c").over(Window.partitionBy(*keys, "a", "b", "x"))
    pz = F.sum("c").over(Window.partitionBy(*keys, "a", "b", "z"))
    info = staged(joint.withColumn("_t", F.col("c") / n * F.log(F.col("c") * n / (px * pz)))
                  .groupBy(*keys, "a", "b").agg(F.sum("_t").alias("mi")))      # a row per pair, read three times
    own = info.filter("a = b").select(*keys, F.col("b").alias("_b"), F.col("mi").alias("_own"))
    ways = info.filter("a <> b").unionByName(info.filter("a <> b").select(
        *keys, F.col("b").alias("a"), F.col("a").alias("b"), "mi")).withColumnRenamed("b", "_b")
    names = F.array(*[F.lit(x) for x in ids])
    ratio = F.when(F.col("_own") > 0, F.col("mi") / F.col("_own")).otherwise(0.0)
    return ways.join(own, keys + ["_b"]).select(
        *keys, names[F.col("a")].alias("i"), names[F.col("_b")].alias("j"), ratio.alias("shared"))


def similar_by_information(shared: DataFrame, limit: float, excluded: DataFrame | None = None,
                           keys: list[str] | None = None) -> DataFrame:
    """Pairs that share more than ``limit``, without discarded or replaced models."""
    close = shared.filter(F.col("shared") > limit)
    if excluded is not None:
        gone = excluded.select(*keys, F.col("model_id").alias("j")).distinct()
        close = close.join(gone, keys + ["j"], "left_anti")
    return close
