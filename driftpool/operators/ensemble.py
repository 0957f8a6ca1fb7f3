"""Weights of ensembles over a pool of models, from one pass over scored rows.

``stats`` are the moments of the base predictions (``gram.moments`` over the
positions of ``preds``): accuracy, distances between models and every least
squares fit follow from them, so no method reads the rows a second time.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from driftpool.functions import linalg
from driftpool.operators import gram
from driftpool.plans import config
from driftpool.plans.sequence import running_sum
from driftpool.session import join_bounded


def prediction_moments(wide: DataFrame, keys: list[str], size: int, y: str = "y") -> DataFrame:
    """Moments of ``preds[0..size-1]`` per key; partial sums are combined before the shuffle."""
    names = [f"_p{i}" for i in range(size)]
    flat = wide.select(*keys, y, *[F.col("preds")[i].alias(n) for i, n in enumerate(names)])
    return gram.moments(flat, keys, names, y)


def accuracies(m: linalg.Moments) -> tuple[np.ndarray, np.ndarray]:
    """R2 and MSE of every base model."""
    residual = np.maximum(np.diag(m.xx) - 2.0 * m.xy + m.yy, 0.0)
    total = max(m.yy - m.sy * m.sy / m.n, 0.0)
    flat = total <= 1e-12 * max(m.yy, 1e-300)
    r2 = np.where(residual <= 1e-12, 1.0, 0.0) if flat else 1.0 - residual / total
    return r2, residual / m.n


def prediction_distances(m: linalg.Moments) -> np.ndarray:
    square = np.diag(m.xx)
    return np.sqrt(np.maximum(square[:, None] + square[None, :] - 2.0 * m.xx, 0.0))


def subset(m: linalg.Moments, kept: np.ndarray) -> linalg.Moments:
    return linalg.Moments(m.n, m.sx[kept], m.sy, m.xx[np.ix_(kept, kept)], m.xy[kept], m.yy)


def stacked(m: linalg.Moments, kept: np.ndarray, solve=linalg.ols, lines=None):
    """Least squares over the kept models; the others get weight 0.

    ``lines`` (features, coefficients, intercepts) are the models' own: with fewer features than models the
    least squares is solved in the space of features.
    """
    w = np.zeros(len(m.xy))
    part, b = solve(subset(m, np.flatnonzero(kept))) if lines is None else linalg.ols_of_lines(
        subset(m, np.flatnonzero(kept)), lines[0], lines[1][:, kept])
    w[np.flatnonzero(kept)] = part
    return w, b


def or_best_three(kept: np.ndarray, r2: np.ndarray) -> np.ndarray:
    """Before the first own model: if the cull leaves nothing, keep the best three."""
    if kept.any():
        return kept
    out = np.zeros(len(kept), dtype=bool)
    out[np.argsort(-r2, kind="stable")[:3]] = True
    return out


def information_cull(kept: np.ndarray, r2: np.ndarray, mi: np.ndarray, limit: float, target: int | None):
    """Of two models that share more information than ``limit`` the less accurate goes, in pool order."""
    kept = kept.copy()
    for k in range(len(kept)):
        for other in range(len(kept)):
            if not kept[k]:
                break
            if other == k or not kept[other] or target in (k, other):
                continue
            if mi[k, other] > limit:
                kept[other if r2[k] > r2[other] else k] = False
    return kept


def angle_cull(d: np.ndarray, limit: float, k: int = config.NEIGHBOURS_CULL) -> np.ndarray:
    """Models in order of arrival; one too close to a model already in the pool stays out."""
    kept = []
    for new in range(len(d)):
        trial = kept + [new]
        if len(trial) > 1:
            closest = np.sort(linalg.last_affinity(d[np.ix_(trial, trial)], k))[-2]
            if closest >= limit:
                continue
        kept = trial
    out = np.zeros(len(d), dtype=bool)
    out[kept] = True
    return out


def clusters(d: np.ndarray, k: int = config.NEIGHBOURS_ENSEMBLE) -> np.ndarray:
    return linalg.self_tuned_clusters(linalg.local_affinity(d, k), config.MAX_ENSEMBLE)


def best_of_clusters(names: np.ndarray, r2: np.ndarray, target: int | None) -> np.ndarray:
    """Most accurate model of each cluster, and the target."""
    kept = np.zeros(len(names), dtype=bool)
    for c in np.unique(names):
        members = [i for i in np.flatnonzero(names == c) if i != target]
        if members:
            kept[max(members, key=lambda i: r2[i])] = True
    if target is not None:
        kept[target] = True
    return kept


def weigh(kind: str, m: linalg.Moments, target: int | None, d: np.ndarray | None = None,
          mi=None, perf_cull: float = config.PERF_CULL,
          mi_cull: float = config.MI_CULL, angle: float = config.ANGLE_CULL, found: dict | None = None, lines=None):
    """Weights and intercept of one pool; ``target`` is the position of the own model, if any.

    ``found`` keeps what depends on the pool alone for the next call. ``mi`` is the matrix of shared information, or a
    function that gives it for the models that are left. ``lines`` are those of ``stacked``.
    """
    r2, mse = accuracies(m)
    found = {} if found is None else found

    def once(name, value):
        if name not in found:
            found[name] = value()
        return found[name]

    every = np.ones(len(r2), dtype=bool)

    def culled():
        kept = r2 > perf_cull
        if target is not None:
            kept[target] = True
            return kept
        return or_best_three(kept, r2)

    if kind == "ols":
        return stacked(m, every, lines=lines)
    if kind == "non_negative":
        return stacked(m, every, linalg.non_negative)
    if kind == "r2":
        w = np.maximum(r2, 1e-14)
        return w / w.sum(), 0.0
    if kind == "mse":
        w = 1.0 / np.maximum(mse, 1e-14)
        return w / w.sum(), 0.0
    if kind == "ols_perf":
        return stacked(m, culled(), lines=lines)
    if kind == "ols_information":
        kept = culled()
        if callable(mi):
            left, shared = np.flatnonzero(kept), np.zeros((len(r2), len(r2)))
            shared[np.ix_(left, left)] = mi(left)
            mi = shared
        return stacked(m, information_cull(kept, r2, mi, mi_cull, target), lines=lines)
    if kind == "ols_angles":
        kept = once("kept", lambda: angle_cull(d, angle)).copy()
        if target is not None:
            kept[target] = True
        kept &= culled()
        return stacked(m, kept if kept.any() else culled(), lines=lines)
    if kind in ("ols_near", "ols_near_angles"):
        names = once("clusters", lambda: clusters(prediction_distances(m) if kind == "ols_near" else d))
        own = names[target] if target is not None else names[0]
        return stacked(m, names == own, lines=lines)
    if kind in ("ols_clusters", "ols_cluster_angles"):
        names = once("clusters", lambda: clusters(prediction_distances(m) if kind == "ols_clusters" else d))
        return stacked(m, best_of_clusters(names, r2, target), lines=lines)
    if kind == "accuracy_weighted":
        kept = r2 > 0
        if target is not None:
            kept[target] = True
        if not kept.any():
            kept = or_best_three(kept, r2)
        if kept.sum() > config.MAX_ENSEMBLE:
            worst = [i for i in np.argsort(-mse, kind="stable") if kept[i] and i != target]
            kept[worst[:int(kept.sum()) - config.MAX_ENSEMBLE]] = False
        total = mse[kept].sum()
        w = np.where(kept, 1.0 - mse / max(total, 1e-300), 0.0)
        if kept.sum() == 1:
            w = kept.astype(float)
        return w / w.sum(), 0.0
    if kind == "equal":
        return np.full(len(r2), 1.0 / len(r2)), 0.0
    raise ValueError(f"unknown ensemble {kind}")


KINDS = ("ols", "non_negative", "r2", "mse", "ols_perf", "ols_information", "ols_angles", "ols_near",
         "ols_near_angles", "ols_clusters", "ols_cluster_angles", "accuracy_weighted", "equal", "ridge_cv")


REGISTERED = {}


def register(name: str, fit) -> None:
    """Add an ensemble along streams: ``fit(predictions, y, target) -> (weights, intercept)``.

    ``predictions`` has a column for each base, ``target`` is the column of the own model or None. Jobs started
    from now on carry the function to their tasks.
    """
    if name in KINDS:
        raise ValueError(f"{name} is taken")
    REGISTERED[name] = fit


def weights(stats: DataFrame, keys: list[str], kind: str, target: int | None = None,
            pcs: str | None = None, mi: str | None = None, **limits) -> DataFrame:
    """``weights`` and ``intercept`` per key from ``prediction_moments``.

    ``pcs`` names a column with the principal directions of each model, ``mi``
    one with the row-major matrix of shared information.
    """
    columns = ["n", "sx", "sy", "xx", "xy", "yy"] + [c for c in (pcs, mi) if c]

    @F.pandas_udf("weights array<double>, intercept double")
    def solve(*series: pd.Series) -> pd.DataFrame:
        out = []
        for values in zip(*series):
            m = gram.unpack(*values[:6])
            extra = list(values[6:])
            size = len(m.xy)
            d = angle_matrix(extra.pop(0)) if pcs else None
            shared = np.asarray(extra.pop(0), dtype=float).reshape(size, size) if mi else None
            w, b = weigh(kind, m, target, d, shared, **limits)
            out.append((w.tolist(), float(b)))
        return pd.DataFrame(out, columns=["weights", "intercept"])

    return stats.withColumn("_w", solve(*columns)).select(*keys, "_w.weights", "_w.intercept")


def angle_matrix(pcs) -> np.ndarray:
    bases = [np.array([list(c) for c in p], dtype=float).T for p in pcs]
    d = np.zeros((len(bases), len(bases)))
    for i in range(len(bases)):
        for j in range(i + 1, len(bases)):
            d[i, j] = d[j, i] = linalg.angle_distance(bases[i], bases[j])
    return d


# -- the same rules where plain columns are enough ----------------------------

def scores(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """R2 and MSE of every model on its rows."""
    from driftpool.functions import metrics
    return pairs.groupBy(*keys, "model_id").agg(
        F.count("*").alias("n"), metrics.r2("y", "p").alias("r2"), metrics.mse("y", "p").alias("mse"))


def _share(value: Column, keys: list[str]) -> Column:
    return value / F.sum(value).over(Window.partitionBy(*keys))


def r2_weights(scored: DataFrame, keys: list[str]) -> DataFrame:
    return scored.withColumn("weight", _share(F.greatest("r2", F.lit(1e-14)), keys))


def mse_weights(scored: DataFrame, keys: list[str]) -> DataFrame:
    return scored.withColumn("weight", _share(1 / F.greatest("mse", F.lit(1e-14)), keys))


def equal_weights(scored: DataFrame, keys: list[str]) -> DataFrame:
    return scored.withColumn("weight", 1 / F.count("*").over(Window.partitionBy(*keys)))


def perf_cull(scored: DataFrame, keys: list[str], limit: float, fallback: int = 3) -> DataFrame:
    """Models above the limit; a pool without any keeps its best ``fallback`` ones."""
    per = Window.partitionBy(*keys)
    passed = F.count(F.when(F.col("r2") > limit, 1)).over(per)
    place = F.row_number().over(per.orderBy(F.desc("r2"), "model_id"))
    return (scored.withColumn("_passed", passed).withColumn("_place", place)
            .filter((F.col("r2") > limit) | ((F.col("_passed") == 0) & (F.col("_place") <= fallback)))
            .drop("_passed", "_place"))


def accuracy_weights(scored: DataFrame, keys: list[str]) -> DataFrame:
    """``1 - mse / sum(mse)`` over models with positive R2."""
    kept = scored.filter("r2 > 0")
    return kept.withColumn("weight", 1 - F.col("mse") / F.sum("mse").over(Window.partitionBy(*keys)))


def decayed_weights(pairs: DataFrame, keys: list[str], block: int, start: float = 1.0) -> DataFrame:
    """Weights after each block of rows when every error decays a model: ``start * decay^(sum of errors)``.

    ``log_weight`` stays exact where the weight itself underflows to 0.
    """
    blocks = (pairs.withColumn("block", F.floor((F.col("seq") - 1) / block))
              .groupBy(*keys, "model_id", "block").agg(F.sum(F.abs(F.col("p") - F.col("y"))).alias("_e")))
    summed = running_sum(blocks.withColumnRenamed("block", "seq"), keys + ["model_id"], F.col("_e"), "_sum")
    log_weight = float(np.log(start)) + float(np.log(config.DECAY)) * F.col("_sum")
    return (summed.withColumn("log_weight", log_weight)
            .select(*keys, "model_id", F.col("seq").alias("block"), "log_weight", F.exp("log_weight").alias("weight")))


def joining_weight(pairs: DataFrame, weighted: DataFrame, keys: list[str]) -> DataFrame:
    """Weight of a model that joins: a share of the pool's weighted loss on one row."""
    on = [c for c in weighted.columns if c != "weight"]
    loss = join_bounded(pairs, weighted, on).withColumn("_l", F.col("weight") * F.abs(F.col("p") - F.col("y")))
    return loss.groupBy(*keys).agg((config.ADD_WEIGHT * F.sum("_l")).alias("weight"))
