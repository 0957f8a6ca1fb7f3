"""Ensembles along streams: own model and received models, weighted anew every half window.

What a stream detects and learns depends only on its own errors, so the loop
runs first and the rest is ordinary DataFrame work: publications become a
registry, edges turn it into pools, and weights are fitted per chunk of a
stream. A weight needs at most the last ``2 * window`` rows, so chunks carry a
halo and one long stream is spread over many tasks.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from driftpool.functions import linalg
from driftpool.operators import ensemble, loop, pool
from driftpool.operators.score import score_pool
from driftpool.plans import config
from driftpool.plans.config import LoopConfig
from driftpool.plans.sequence import CHUNK_ROWS, tasks_for, with_halo
from driftpool.session import staged

MI_BINS = 16


def registry(result: DataFrame, epoch_rows: int) -> DataFrame:
    """Published models with the epoch they were published in."""
    return loop.published_of(result).select(
        F.col("domain").alias("source"), F.concat_ws("-", "domain", "model_id").alias("model_id"),
        F.floor(F.col("seq") / epoch_rows).alias("epoch"), "coef", "intercept", "pcs")


def receive_points(result: DataFrame) -> DataFrame:
    """Rows at which a stream asks for models: its first fit and every change of model."""
    return result.filter(F.col("kind").isin("learn", "reuse")).select("domain", "seq")


def deliveries(models: DataFrame, edges: DataFrame, points: DataFrame, epoch_rows: int) -> DataFrame:
    """When each target first gets each model: its next request after the model is visible."""
    offered = (edges.join(models.withColumnRenamed("source", "src"), "src")
               .select(F.col("dst").alias("domain"), "model_id", ((F.col("epoch") + 1) * epoch_rows).alias("at")))
    asked = points.select("domain", F.lit(None).cast("string").alias("model_id"), F.col("seq").alias("at"))
    ahead = Window.partitionBy("domain").orderBy("at", F.col("model_id").isNull()).rowsBetween(0, Window.unboundedFollowing)
    ask = F.when(F.col("model_id").isNull(), F.col("at"))
    return (offered.unionByName(asked).withColumn("usable_from", F.min(ask).over(ahead))
            .filter(F.col("model_id").isNotNull() & F.col("usable_from").isNotNull())
            .select("domain", "model_id", "usable_from"))


def own_stable(result: DataFrame, stable: int) -> DataFrame:
    """Own models join the pool at the end of the run in which they became stable."""
    used = F.sum("length").over(Window.partitionBy("domain", "model_id").orderBy("start_seq"))
    runs = loop.segments_of(result).withColumn("_used", used)
    return runs.filter(F.col("_used") >= stable).groupBy("domain", "model_id").agg(
        (F.min("end_seq") + 1).alias("usable_from"))


def pools(result: DataFrame, edges: DataFrame, cfg: LoopConfig, epoch_rows: int,
          initial: DataFrame | None = None) -> DataFrame:
    """Models each stream may combine, and from which row on."""
    published = registry(result, epoch_rows)
    got = deliveries(published, edges, receive_points(result), epoch_rows)
    foreign = got.join(published.drop("source", "epoch"), "model_id").select(
        "domain", "model_id", "coef", "intercept", "pcs", "usable_from")
    own = own_stable(result, cfg.stable).join(loop.models_of(result).drop("seq"), ["domain", "model_id"]).select(
        "domain", "model_id", "coef", "intercept", "pcs", "usable_from")
    out = foreign.unionByName(own)
    if initial is not None:
        out = out.unionByName(initial.select("domain", "model_id", "coef", "intercept", "pcs", F.lit(1).cast("bigint").alias("usable_from")))
    return out


def remember(stream: DataFrame, pooled: DataFrame, cfg: LoopConfig, size: int = config.MAX_ENSEMBLE) -> DataFrame:
    """Pools that hold ``size`` models and remember whom they turned out: adds ``usable_to``.

    Whenever a model becomes usable, it and the members are compared by their
    errors on the last window of the stream; who is turned out stays out.
    """
    pooled = staged(pooled)
    joins = pooled.select("domain", "model_id", F.col("usable_from").alias("at"))
    near = pool.recent_rows(stream.select("domain", "seq", "features", "y"), joins, cfg.window)
    models = pooled.select("domain", "model_id", "coef", "intercept", "usable_from")
    scored = score_pool(near, models).filter("usable_from <= at")
    error = F.col("y") - F.col("p")
    scores = staged(scored.groupBy("domain", "at", "model_id").agg(F.avg(error * error).alias("mse")))
    spans = pool.remembered(scores, joins, size).select(
        "domain", "model_id", F.col("start_seq").alias("usable_from"), F.col("end_seq").alias("usable_to"))
    return pooled.join(spans, ["domain", "model_id", "usable_from"])


def traffic_of(result: DataFrame, edges: DataFrame, epoch_rows: int) -> DataFrame:
    """Messages and bytes by stream: sent once per neighbour, received when asked for."""
    models = registry(result, epoch_rows).withColumn("bytes", 8 * (F.size("coef") + 1).cast("bigint"))
    sent = edges.join(models.withColumnRenamed("source", "src"), "src").select(
        F.col("src").alias("domain"), F.lit("sent").alias("kind"), "bytes")
    got = deliveries(models, edges, receive_points(result), epoch_rows).join(models.select("model_id", "bytes"), "model_id").select(
        "domain", F.lit("received").alias("kind"), "bytes")
    return pool.traffic(sent.unionByName(got), ["domain"], ("sent", "received"))


def _fit(kind: str, base: np.ndarray, y: np.ndarray, target: int | None, angles, limits: dict, found: dict, lines):
    if len(y) < config.LEAST_HISTORY:
        return np.full(base.shape[1], 1.0 / base.shape[1]), 0.0
    if kind == "ridge_cv":
        return linalg.ridge_cv(base, y, config.RIDGE_CV_ALPHAS, lines)
    d = mi = None
    if kind in ("ols_angles", "ols_near_angles", "ols_cluster_angles"):
        # directions belong to models: same pool, same distances and clusters
        if "d" not in found:
            found["d"] = angles()
        d = found["d"]
    else:
        found = {}
    if kind == "ols_information":
        mi = lambda kept: linalg.information_matrix(base[:, kept], MI_BINS)
    return ensemble.weigh(kind, linalg.Moments.of_rows(base, y), target, d, mi, found=found, lines=lines, **limits)


class _Angles:
    """Distances between the directions of a chunk's models; a pair is computed when it is first asked for."""

    def __init__(self):
        self.place, self.bases, self.d = {}, [], np.zeros((0, 0))

    def among(self, keys: list, pcs: list) -> np.ndarray:
        for key, p in zip(keys, pcs):
            if key not in self.place:
                self.place[key] = len(self.bases)
                self.bases.append(np.array([list(c) for c in p], dtype=float).T)
        at, size = [self.place[k] for k in keys], len(self.bases)
        if size > len(self.d):
            wider = np.full((2 * size, 2 * size), np.nan)
            wider[:len(self.d), :len(self.d)] = self.d
            np.fill_diagonal(wider, 0.0)
            self.d = wider
        for i, j in np.argwhere(np.isnan(self.d[np.ix_(at, at)])):
            i, j = at[i], at[j]
            if np.isnan(self.d[i, j]):
                low, high = min(i, j), max(i, j)
                self.d[i, j] = self.d[j, i] = linalg.angle_distance(self.bases[low], self.bases[high])
        return self.d[np.ix_(at, at)]


def _rows_of_chunk(rows: pa.Table):
    """Rows of the stream beside the loop's, in order: (seq, home, features, y, model in use, its predictions)."""
    told = rows.column("told").to_numpy()
    ours, loops = rows.filter(pa.array(~told)), rows.filter(pa.array(told))
    a, b = ours.column("seq").to_numpy(), loops.column("seq").to_numpy()
    left, right = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    if not np.array_equal(a[left], b[right]) or (np.diff(a[left]) == 0).any():
        both = pd.DataFrame({"seq": a[left], "a": left}).merge(pd.DataFrame({"seq": b[right], "b": right}), "inner", "seq")
        left, right = both["a"].to_numpy(), both["b"].to_numpy()
    if not len(left):
        return None
    ours, loops = ours.take(pa.array(left)).combine_chunks(), loops.take(pa.array(right)).combine_chunks()
    y = ours.column("y").to_numpy()
    x = ours.column("features").chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
    return (ours.column("seq").to_numpy(), ours.column("home").to_numpy(), x, y,
            np.array(loops.column("model_id").to_pylist(), dtype=object), loops.column("p").to_numpy())


def _chunk_weigher(kind: str, cfg: LoopConfig, limits: dict, refits: bool = False, members: str = "rows"):
    w = cfg.window
    own_rule = ensemble.REGISTERED.get(kind)
    schema = to_arrow_schema(_parse_datatype_string(REFITS if refits else SCHEMA))

    def one(rows: pa.Table, models: pa.Table) -> pa.Table:
        found = _rows_of_chunk(rows) if rows.num_rows else None
        if found is None:
            return schema.empty_table()
        seq, home, x, y, used, target_p = found
        domain = rows.column("domain")[0].as_py()
        table = models.to_pandas().drop_duplicates(["role", "model_id", "usable_from"])
        moments = set(table.loc[table.role == "change", "usable_from"].astype(int) + 1)
        own = {m.model_id: m for m in table[table.role == "own"].itertuples()}
        base = table[table.role == "pool"].sort_values(["usable_from", "model_id"])
        ids, since, until = (base[c].to_numpy() for c in ("model_id", "usable_from", "usable_to"))
        base_pcs = base["pcs"].to_numpy()
        base_coef = np.stack(base["coef"].to_numpy()).T if len(base) else np.zeros((x.shape[1], 0))
        base_bias = base["intercept"].to_numpy()
        bases_p = x @ base_coef + base_bias if len(base) else np.zeros((len(y), 0))
        begins = np.isin(seq, list(moments)) | (seq == w + 1) | np.where(
            seq > w, seq % (w // 2) == 0, seq % max(w // 4, 1) == 0)
        begins[0] = True
        begins[1:] |= used[1:] != used[:-1]
        starts = np.flatnonzero(begins).tolist()
        out_p, out_n, out_ids = np.empty(len(y)), np.zeros(len(y), dtype=int), [None] * len(y)
        seen, fits, distances = {}, [], _Angles()
        for at, stop in zip(starts, starts[1:] + [len(y)]):
            if not home[at:stop].any():
                continue
            first = seq[at]
            fresh = first in moments or first <= w + 1
            back = max(0, at - (w if fresh else 2 * w))
            mine = used[at]
            member = (since <= first) & (first < until) & (ids != mine)
            names = list(ids[member])
            # of a chunk's first part only rows behind the halo are given out
            told = range(at, stop) if members == "rows" else (at + int(np.argmax(home[at:stop])),) if members == "starts" else ()
            if mine is None:
                if not names:
                    out_p[at:stop] = target_p[at:stop]
                    for i in told:
                        out_ids[i] = []
                    continue
                train, ahead, target = bases_p[back:at][:, member], bases_p[at:stop][:, member], None
                pcs, coef, bias = list(base_pcs[member]), base_coef[:, member], base_bias[member]
            else:
                m = own[mine]
                coef = np.asarray(m.coef)
                train = np.column_stack([bases_p[back:at][:, member], x[back:at] @ coef + m.intercept])
                ahead = np.column_stack([bases_p[at:stop][:, member], target_p[at:stop]])
                pcs = list(base_pcs[member]) + [m.pcs]
                coef, bias = np.column_stack([base_coef[:, member], coef]), np.append(base_bias[member], m.intercept)
                target, names = len(names), names + [mine]
            if own_rule is None:
                cached = seen.setdefault(tuple(names), {})
                keys = np.flatnonzero(member).tolist() + ([] if mine is None else [mine])     # places in the pool, own name
                weights, b = _fit(kind, train, y[back:at], target, lambda: distances.among(keys, pcs), limits, cached,  # noqa: B023
                                  (x[back:at], coef, bias))
            else:
                weights, b = own_rule(train, y[back:at], target)
            if home[at]:
                fits.append((seq[at], names, weights, b))
            out_p[at:stop] = ahead @ weights + b
            kept = [n for n, v in zip(names, weights) if v != 0.0]
            out_n[at:stop] = len(kept)
            for i in told:
                out_ids[i] = kept
        if refits:
            columns = [[domain] * len(fits), [f[0] for f in fits], [f[1] for f in fits],
                       [list(map(float, f[2])) for f in fits], [float(f[3]) for f in fits]]
        else:
            columns = [[domain] * int(home.sum()), seq[home], y[home], target_p[home], out_p[home], out_n[home],
                       [o for o, h in zip(out_ids, home) if h]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
    return one


SCHEMA = "domain string, seq bigint, y double, p_own double, p double, n_bases int, bases array<string>"
REFITS = "domain string, seq bigint, members array<string>, weights array<double>, intercept double"


def combine(stream: DataFrame, result: DataFrame, pooled: DataFrame, cfg: LoopConfig, kind: str,
            chunk_rows: int = CHUNK_ROWS, members: str = "rows", **limits) -> DataFrame:
    """Ensemble prediction of every row, next to the own model's.

    Weights are refitted every half window on the last two windows, and after
    each change of model on the last window; a period in the burn-in uses
    received models only. Pools with ``usable_to`` are left at that row.
    ``bases`` names the members for all ``rows``, where they ``starts`` to hold
    (and where a chunk starts; null elsewhere), or ``none``.
    """
    if members not in ("rows", "starts", "none"):
        raise ValueError("members must be rows, starts or none")
    return _weighed(stream, result, pooled, cfg, kind, chunk_rows, False, limits, members)


def refits(stream: DataFrame, result: DataFrame, pooled: DataFrame, cfg: LoopConfig, kind: str,
           chunk_rows: int = CHUNK_ROWS, **limits) -> DataFrame:
    """Members and weights of ``combine`` from each row at which they are fitted anew; rows without any model have none."""
    return _weighed(stream, result, pooled, cfg, kind, chunk_rows, True, limits)


def _weighed(stream, result, pooled, cfg, kind, chunk_rows, refits, limits, members="rows"):
    if kind not in ensemble.KINDS and kind not in ensemble.REGISTERED:
        raise ValueError(f"ensemble must be registered or one of {ensemble.KINDS}")
    never = F.lit(2 ** 62).cast("bigint").alias("usable_to")
    tasks = tasks_for(stream.sparkSession, stream.count())
    # rows and the loop's predictions meet in the chunk, so neither is shuffled for a join before
    halo = lambda df: with_halo(df.filter("domain IS NOT NULL"), behind=3 * cfg.window, chunk_rows=chunk_rows)
    given = halo(stream.select("domain", "seq", "features", "y"))
    scored = halo(loop.rows_of(result).select("domain", "seq", "model_id", "p"))
    rows = given.withColumn("told", F.lit(False)).unionByName(scored.withColumn("told", F.lit(True)), allowMissingColumns=True)
    # change points reach the chunks whose rows they can affect
    change = receive_points(result).unionByName(
        result.filter("kind = 'temporary'").select("domain", "seq")).withColumn("usable_from", F.col("seq"))
    change = with_halo(change, behind=3 * cfg.window + 1, chunk_rows=chunk_rows).select(
        "domain", "chunk", F.lit("change").alias("role"), F.lit(None).cast("string").alias("model_id"),
        F.lit(None).cast("array<double>").alias("coef"), F.lit(None).cast("double").alias("intercept"),
        F.lit(None).cast("array<array<double>>").alias("pcs"), "usable_from", never)
    learned = result.filter(F.col("kind").isin("learn", "temporary")).select("domain", "model_id", "coef", "intercept", "pcs")
    uses = scored.select("domain", "chunk", "model_id").filter("model_id is not null").distinct()
    own = uses.join(learned, ["domain", "model_id"]).select(
        "domain", "chunk", F.lit("own").alias("role"), "model_id", "coef", "intercept", "pcs", F.lit(0).cast("bigint").alias("usable_from"), never)
    spans = scored.groupBy("domain", "chunk").agg(F.max("seq").alias("_end"))
    shared = spans.join(pooled, "domain").filter(F.col("usable_from") <= F.col("_end")).select(
        "domain", "chunk", F.lit("pool").alias("role"), "model_id", "coef", "intercept", "pcs", F.col("usable_from").cast("bigint"),
        F.coalesce("usable_to", never).alias("usable_to") if "usable_to" in pooled.columns else never)
    models = change.unionByName(own).unionByName(shared)
    rows, models = rows.repartition(tasks, "domain", "chunk"), models.repartition(tasks, "domain", "chunk")
    return (rows.groupBy("domain", "chunk").cogroup(models.groupBy("domain", "chunk"))
            .applyInArrow(_chunk_weigher(kind, cfg, limits, refits, members), REFITS if refits else SCHEMA))
