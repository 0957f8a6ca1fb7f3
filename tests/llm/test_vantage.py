import hashlib

import numpy as np
import pytest

from driftpool.llm import vantage


def nearest(x, centroids):
    d = ((x[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


@pytest.mark.parametrize("spread, many", [(2, 40), (1000, 40), (1, 200), (50, 1), (5, 5)])
def test_tree_against_all_distances(spread, many):
    """Small spreads give many equal distances and equal centroids: the smallest number wins."""
    rng = np.random.default_rng(spread + many)
    for size in (2, 64):
        centroids = rng.integers(-spread, spread + 1, (many, size))
        x = rng.integers(-spread, spread + 1, (5000, size))
        which, d = vantage.Tree(centroids).nearest(x)
        want, least = nearest(x, centroids)
        assert (which == want).all() and (d == least).all()


def test_tree_turns_centroids_away(monkeypatch):
    """Far clusters are not compared: the tree prunes."""
    asked = []
    squared = vantage._squared
    monkeypatch.setattr(vantage, "_squared", lambda x, c: asked.append(len(x)) or squared(x, c))
    rng = np.random.default_rng(1)
    centroids = rng.integers(-10_000, 10_000, (40, 2))
    tree = vantage.Tree(centroids)
    asked.clear()
    tree.nearest(np.repeat(centroids, 50, axis=0) + rng.integers(-3, 4, (2000, 2)))
    assert sum(asked) < 2000 * 20


def brute(rows, clusters, rounds, size):
    kept = [(i, np.array([int(np.floor(256 * float(x))) for x in v], np.int64)) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1].tolist())
    centroids = np.array([v for _, v in sorted(kept, key=key)[:clusters]])
    x = np.array([v for _, v in kept])
    for _ in range(rounds):
        which, _ = nearest(x, centroids)
        for c in set(which.tolist()):
            mine = x[which == c]
            centroids[c] = [int(s) // len(mine) for s in mine.sum(axis=0).tolist()]
    which, d = nearest(x, centroids)
    return sorted(((i is None, i), int(c), int(k)) for (i, _), c, k in zip(kept, which, d)), centroids


def test_rounds_ties_and_odd_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(k, [float(x) for x in rng.integers(-3, 4, 4) / 256]) for k in range(400)]
    rows += [(1000, [0.0] * 4)] * 5 + [(None, [0.1] * 4), (3, None), (4, [1.0]), (5, [1.0, None, 2.0, 3.0]),
                                       (6, [float("nan"), 1.0, 1.0, 1.0]), (7, [float("inf")] * 4), (8, [])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, cluster int")
    got, centroids = vantage.clustered(table, clusters=10, dimensions=4)
    want, ends = brute(rows, 10, 5, 4)
    assert sorted(((r.id is None, r.id), r.cluster, r.distance) for r in got.collect()) == want
    assert (centroids == ends).all()
    # fewer vectors than centroids, one of them repeated
    got, centroids = vantage.clustered(table.filter("vec_id = 1000"), clusters=10, dimensions=4)
    assert {(r.cluster, r.distance) for r in got.collect()} == {(0, 0)} and len(centroids) == 5


def test_empty_and_too_large(spark):
    schema = "vec_id long, embedding array<float>"
    assert vantage.described(*vantage.clustered(spark.createDataFrame([], schema))).count() == 0
    large = spark.createDataFrame([(1, [1e9] * 64)], schema)
    with pytest.raises(Exception, match="a component beyond"):
        vantage.clustered(large)
