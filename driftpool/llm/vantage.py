"""Centroid clustering of integer vectors; the nearest centroid is found in a vantage-point tree over the centroids."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from driftpool.session import staged

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 40, 5, 64, 256, 2
LEAF = 4             # centroids of a leaf at most
MOST = 1 << 27       # largest component whose squared distances are whole numbers of 64 bits (64 dimensions)
BLOCK = 4096


def _squared(x, c):
    apart = x - c
    return np.einsum("ij,ij->i", apart, apart)


class Tree:
    """Centroids below vantage points: each side of one has the range of its distances to it."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.nodes = []
        self._grow(np.arange(len(centroids)))

    def _grow(self, members):
        at = len(self.nodes)
        self.nodes.append((members, ()))
        if len(members) > LEAF:
            point, rest = members[:1], members[1:]
            away = np.sqrt(_squared(self.centroids[rest], self.centroids[point]).astype(float))
            order = np.argsort(away, kind="stable")
            half = len(rest) // 2
            self.nodes[at] = (point, [(self._grow(rest[side]), away[side].min(), away[side].max())
                                      for side in (order[:half], order[half:])])
        return at

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each row, the smaller number of equals.

        Every vector takes its own nodes in the order of their lower bounds, until the next bound is beyond its
        radius. A bound equal to the radius is followed: a centroid as near may have a smaller number. Bounds are
        floats lowered by more than they may be off; distances are compared as whole numbers.
        """
        parts = [self._nearest(x[at:at + BLOCK]) for at in range(0, len(x), BLOCK)]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(p) for p in zip(*parts))

    def _nearest(self, x):
        bounds = np.full((len(x), len(self.nodes)), np.inf)
        bounds[:, 0] = 0.0
        best = np.full(len(x), np.iinfo(np.int64).max)
        which = np.full(len(x), len(self.centroids), np.int64)
        rows = np.arange(len(x))
        while len(rows):
            node = bounds[rows].argmin(axis=1)
            bound = bounds[rows, node]
            near = bound <= np.sqrt(best[rows].astype(float))
            rows, node, bound = rows[near], node[near], bound[near]
            bounds[rows, node] = np.inf
            for one in np.unique(node).tolist():
                here = node == one
                mine, low = rows[here], bound[here]
                members, sides = self.nodes[one]
                for c in members.tolist():
                    d = _squared(x[mine], self.centroids[c])
                    better = (d < best[mine]) | ((d == best[mine]) & (c < which[mine]))
                    best[mine[better]], which[mine[better]] = d[better], c
                if sides:
                    away = np.sqrt(d.astype(float))
                    for child, least, most in sides:
                        edge = np.maximum(away - most, least - away) - 1e-9 * (away + most)
                        bounds[mine, child] = np.maximum(low, edge)
        return which, best


def vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS,
            scale: int = SCALE) -> DataFrame:
    """(id, v): rows whose vector has ``dimensions`` finite components, as whole numbers floor(scale * x).

    Null vectors and vectors with null, infinite or undefined components are left out. A component beyond MOST is an
    error, as its distances are no numbers of 64 bits.
    """
    whole = F.transform(F.col(f"`{vector_col}`"), lambda x: F.floor(x.cast("double") * scale))
    finite = F.forall(F.col(f"`{vector_col}`"), lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                      & (F.abs(x.cast("double")) != float("inf")))
    kept = rows.filter((F.size(F.col(f"`{vector_col}`")) == dimensions) & finite)
    fits = F.forall("v", lambda x: F.abs(x) <= MOST)
    return kept.select(F.col(f"`{id_col}`").alias("id"), whole.alias("v")).select(
        "id", F.when(fits, F.col("v")).otherwise(F.raise_error(F.lit(f"a component beyond {MOST}")).cast("array<bigint>"))
        .alias("v"))


def _matrix(column):
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _moved(rows, tree, k):
    """Sums of the vectors of each centroid: every task adds its own first, so a shuffle has k rows a task at most."""
    def run(batches):
        counts, sums = np.zeros(k, np.int64), None
        for batch in batches:
            x = _matrix(batch.column(0))
            if len(x):
                which, _ = tree.value.nearest(x)
                sums = np.zeros((k, x.shape[1]), np.int64) if sums is None else sums
                counts += np.bincount(which, minlength=k)
                np.add.at(sums, which, x)
        some = np.flatnonzero(counts)
        if len(some):
            yield pa.RecordBatch.from_arrays([
                pa.array(some.astype(np.int32)), pa.array(counts[some]),
                pa.array(sums[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])
    parts = rows.select("v").mapInArrow(run, "cluster int, n bigint, sums array<bigint>")
    exact = "decimal(38,0)"
    each = parts.select("cluster", "n", F.posexplode("sums").alias("place", "s"))
    return each.groupBy("cluster", "place").agg(F.sum(F.col("n").cast(exact)).alias("n"),
                                                F.sum(F.col("s").cast(exact)).alias("s")).collect()


def clustered(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS,
              rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED):
    """Staged (id, cluster, distance) of every kept vector, and the centroids as an array (clusters x dimensions).

    The first centroids are the vectors with the smallest SHA-256 of ``seed:id`` (a null id is empty; equal hashes by
    vector), fewer if there are fewer vectors. A round gives every vector to its nearest centroid and moves each
    centroid that has vectors to floor(sum / count). Repeated rows count as often as they occur. The driver holds
    ``clusters x dimensions`` numbers, whatever the number of vectors; tasks get the tree by broadcast. Without
    vectors the result is empty.
    """
    spark = rows.sparkSession
    kept = staged(vectors(rows, id_col, vector_col, dimensions, scale))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = kept.select(key.alias("key"), "v").orderBy("key", "v").limit(clusters).collect()
    centroids = np.array([r["v"] for r in first], np.int64).reshape(len(first), dimensions)
    for _ in range(rounds if len(first) else 0):
        tree = spark.sparkContext.broadcast(Tree(centroids))
        for r in _moved(kept, tree, len(centroids)):
            centroids[r["cluster"], r["place"]] = int(r["s"]) // int(r["n"])
        tree.destroy()
    tree = spark.sparkContext.broadcast(Tree(centroids))

    def assign(batches):
        for batch in batches:
            which, distance = tree.value.nearest(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(which.astype(np.int32)), pa.array(distance)],
                                             names=["id", "cluster", "distance"])
    kind = kept.schema["id"].dataType.simpleString()
    result = staged(kept.mapInArrow(assign, f"id {kind}, cluster int, distance bigint"))
    tree.destroy()
    return result, centroids


def described(result: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of what ``clustered`` returns."""
    spark = result.sparkSession
    sums = result.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    by_cluster = {r["cluster"]: int(r["s"]) for r in sums.collect()}      # one number a centroid
    total = sum(by_cluster.values())
    facts = [(c, s, total, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
             for c, s in sorted(by_cluster.items())]
    table = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # a row a centroid, as many as the driver holds anyway
    return result.join(F.broadcast(table), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia",
                                                             "centroid_sha256")
