"""Operators on small hand-made inputs, against brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from driftpool import session
from driftpool.functions import linalg, metrics, weather
from driftpool.operators import drift, ensemble, gram, online, pool, score, similar, stream_ops
from driftpool.plans import config, sequence, sweep
from driftpool.plans.config import LoopConfig


@pytest.fixture(scope="module")
def events(spark):
    """Two streams, one of them with most of the rows."""
    source = np.random.default_rng(3)
    rows = []
    for d, n in (("hot", 400), ("cold", 37)):
        for i in range(n):
            rows.append((d, i // 7, i, float(source.random()), str(source.integers(0, 3))))
    source.shuffle(rows)
    return spark.createDataFrame([(d, a, b, v, m) for d, a, b, v, m in rows],
                                 "domain string, day int, tick int, v double, model_id string").cache()


def _numbered(events):
    return sequence.number_rows(events, ["domain"], ["day", "tick"], [F.col("day")])


def test_number_rows_equals_row_number(events):
    plain = F.row_number().over(Window.partitionBy("domain").orderBy("day", "tick"))
    rows = _numbered(events).withColumn("want", plain).collect()
    assert len(rows) == 437 and all(r.seq == r.want for r in rows)
    short = sequence.number_short(events, ["domain"], ["day", "tick"]).withColumn("want", plain).collect()
    assert all(r.seq == r.want for r in short)


@pytest.mark.parametrize("chunk", [1, 5, 64, 1000])
def test_chunked_windows_equal_plain_windows(events, chunk):
    rows = _numbered(events)
    w = Window.partitionBy("domain").orderBy("seq")
    mean = stream_ops.trailing_mean(rows, ["domain"], "v", 9, "m", chunk).withColumn("want", F.avg("v").over(w.rowsBetween(-8, 0)))
    total = sequence.running_sum(rows, ["domain"], F.col("v"), "t", chunk).withColumn("want", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lead = sequence.next_over_chunks(rows.filter("seq % 11 = 0"), ["domain"], F.col("seq"), "n", chunk).withColumn("want", F.lead("seq").over(w))
    for df, name in ((mean, "m"), (total, "t")):
        got = df.collect()
        assert len(got) == 437 and all(abs(r[name] - r["want"]) < 1e-9 for r in got)
    assert all(r.n == r.want for r in lead.collect())


@pytest.mark.parametrize("chunk", [3, 50, 1000])
def test_segments_equal_runs(events, chunk):
    rows = _numbered(events)
    got = {(r.domain, r.model_id, r.start_seq, r.end_seq, r.next_model_id) for r in drift.segments(rows, ["domain"], chunk_rows=chunk).collect()}
    want = set()
    for d in ("hot", "cold"):
        ids = [r.model_id for r in sorted(rows.filter(F.col("domain") == d).collect(), key=lambda r: r.seq)]
        runs = [(k, len(list(g))) for k, g in itertools.groupby(ids)]
        at = 1
        for i, (k, n) in enumerate(runs):
            want.add((d, k, at, at + n - 1, runs[i + 1][0] if i + 1 < len(runs) else None))
            at += n
    assert got == want
    changes = stream_ops.membership_changes(rows.withColumn("b", F.array("model_id")), ["domain"], "b", chunk).collect()
    runs = {d: len([w for w in want if w[0] == d]) - 1 for d in ("hot", "cold")}
    assert {r.domain: r.changes for r in changes} == runs


def test_join_bounded_falls_back_to_salting(spark, events):
    side = spark.createDataFrame([("hot", 1), ("cold", 2), ("none", 3)], "domain string, k int")
    small = session.join_bounded(events, side, ["domain"]).select(events.columns + ["k"])
    large = session.join_bounded(events, side, ["domain"], max_rows=1, salts=5).select(events.columns + ["k"])
    assert sorted(small.collect()) == sorted(large.collect()) and small.count() == 437
    assert "_salt" in large._jdf.queryExecution().toString() and "_salt" not in small._jdf.queryExecution().toString()


def test_shared_folder_follows_the_session(spark):
    assert session.shared_folder(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_moments_and_fits_match_numpy(spark):
    source = np.random.default_rng(1)
    X = source.random((120, 3))
    y = X @ [1.0, -2.0, 0.5] + 0.3 + source.normal(0, 0.1, 120)
    df = spark.createDataFrame([("a", *map(float, x), float(v)) for x, v in zip(X, y)], "domain string, a double, b double, c double, y double")
    for method, settings, want in (("ols", {}, linalg.ols), ("ridge", {"alpha": 2.0}, lambda m: linalg.ridge(m, 2.0)),
                                   ("elastic", {"alpha": 0.001, "l1": 0.7}, lambda m: linalg.elastic(m, 0.001, 0.7, False))):
        row = gram.fit(df, ["domain"], ["a", "b", "c"], "y", method, **settings).first()
        w, b = want(linalg.Moments.of_rows(X, y))
        np.testing.assert_allclose(row.coef, w, atol=1e-9)
        assert abs(row.intercept - b) < 1e-9
    best, *_ = np.linalg.lstsq(np.column_stack([X, np.ones(120)]), y, rcond=None)
    w, b = linalg.ols(linalg.Moments.of_rows(X, y))
    np.testing.assert_allclose(np.append(w, b), best, atol=1e-9)
    pcs = np.array([list(c) for c in gram.components(df, ["domain"], ["a", "b", "c"], "y", 0.05).first().pcs]).T
    whole = np.column_stack([X, y])
    z = (whole - whole.mean(0)) / whole.std(0, ddof=1)
    u = np.linalg.svd(z.T @ z)[0][:, :pcs.shape[1]]
    assert linalg.angle_distance(pcs, u) < 1e-12


def test_non_negative_and_leave_one_out_by_brute_force():
    source = np.random.default_rng(5)
    for _ in range(20):
        X = source.normal(size=(40, 4))
        y = X @ source.normal(size=4)
        w, _b = linalg.non_negative(linalg.Moments.of_rows(X, y))
        best = None
        for k in range(5):
            for cols in itertools.combinations(range(4), k):
                v = np.zeros(4)
                if cols:
                    v[list(cols)] = np.linalg.lstsq(X[:, cols], y, rcond=None)[0]
                if (v >= 0).all():
                    loss = ((y - X @ v) ** 2).sum()
                    best = loss if best is None else min(best, loss)
        assert (w >= 0).all() and ((y - X @ w) ** 2).sum() <= best + 1e-8
    X, y = source.normal(size=(25, 3)), source.normal(size=25)
    losses = []
    for a in config.RIDGE_CV_ALPHAS:
        e = 0.0
        for i in range(25):
            keep = np.arange(25) != i
            v = np.linalg.solve(X[keep].T @ X[keep] + a * np.eye(3), X[keep].T @ y[keep])
            e += (y[i] - X[i] @ v) ** 2
        losses.append(e)
    a = config.RIDGE_CV_ALPHAS[int(np.argmin(losses))]
    np.testing.assert_allclose(linalg.ridge_cv(X, y, config.RIDGE_CV_ALPHAS)[0], np.linalg.solve(X.T @ X + a * np.eye(3), X.T @ y), atol=1e-9)


def test_elastic_net_meets_its_optimality_conditions():
    source = np.random.default_rng(2)
    X = source.normal(size=(80, 5))
    y = X @ [1.0, 0, -1, 0, 0.2] + source.normal(0, 0.1, 80)
    w, b = linalg.elastic(linalg.Moments.of_rows(X, y), 0.01, 0.5, False)
    scale = np.sqrt(((X - X.mean(0)) ** 2).sum(0))
    Z, v = (X - X.mean(0)) / scale, w * scale
    slope = Z.T @ (y - y.mean() - Z @ v) / 80 - 0.01 * 0.5 * v
    on = np.abs(v) > 1e-12
    np.testing.assert_allclose(slope[on], 0.01 * 0.5 * np.sign(v[on]), atol=1e-7)
    assert (np.abs(slope[~on]) <= 0.01 * 0.5 + 1e-9).all()


def test_insensitive_fit_beats_least_squares_under_its_own_loss():
    source = np.random.default_rng(4)
    X = source.random((90, 4))
    y = X @ [1.0, 2.0, -1.0, 0.0] + np.where(source.random(90) < 0.1, 3.0, 0.0)

    def loss(w, b):
        return 0.5 * w @ w + np.maximum(np.abs(y - X @ w - b) - 0.01, 0).sum()
    w, b = linalg.insensitive(X, y, 1.0, 0.01)
    best = loss(w, b)
    assert best < loss(*linalg.ols(linalg.Moments.of_rows(X, y)))
    for _ in range(2000):
        assert loss(w + source.normal(0, 0.05, 4), b + source.normal(0, 0.05)) > best - 0.02


def test_p_values_against_known_numbers(spark):
    rows = spark.createDataFrame([(0.5, 10.0), (0.9, 5.0), (0.0, 30.0), (1.0, 12.0)], "r double, n double")
    got = [x.p for x in rows.select(metrics.pearson_p("r", "n").alias("p")).collect()]
    np.testing.assert_allclose(got, [0.1411132, 0.0373861, 1.0, 0.0], atol=2e-6)


def test_metrics_of_flat_labels(spark):
    rows = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 1.0), ("b", 1.0, 2.0), ("b", 1.0, 1.0), ("c", 0.0, 1.0), ("c", 2.0, 1.0)],
                                 "k string, y double, p double")
    got = {r.k: r.r2 for r in rows.groupBy("k").agg(metrics.r2("y", "p").alias("r2")).collect()}
    assert got == {"a": 1.0, "b": 0.0, "c": 0.0}


def test_pairs_scales_and_affinities(spark):
    source = np.random.default_rng(6)
    v = source.random((6, 3))
    v[1] = v[0]
    df = spark.createDataFrame([(0, f"m{i}", [float(x) for x in r]) for i, r in enumerate(v)], "pool_id int, model_id string, vector array<double>")
    pairs = similar.vector_pairs(df, ["pool_id"]).cache()
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    for k in (1, 3, 7):
        want = linalg.local_affinity(d, k)
        for r in similar.affinities(pairs, ["pool_id"], k).collect():
            i, j = int(r.i[1]), int(r.j[1])
            assert abs(r.d - d[i, j]) < 1e-12 and abs(r.affinity - want[i, j]) < 1e-9
        np.testing.assert_allclose(want, want.T)
        np.testing.assert_allclose(np.diag(want), 1.0)
    same = np.zeros((4, 4))
    np.testing.assert_allclose(linalg.local_affinity(same, 3), 1.0)


def test_clusters_find_separate_groups(spark):
    source = np.random.default_rng(8)
    centres = np.array([[0, 0], [5, 5], [0, 9]])
    points = np.vstack([c + source.normal(0, 0.2, (6, 2)) for c in centres])
    df = spark.createDataFrame([(0, f"m{i:02d}", [float(x) for x in p]) for i, p in enumerate(points)], "pool_id int, model_id string, vector array<double>")
    pairs = similar.affinities(similar.vector_pairs(df, ["pool_id"]), ["pool_id"], 3)
    found = similar.clusters(pairs, ["pool_id"]).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.cluster, set()).add(int(r.model_id[1:]) // 6)
    assert len(found) == 18 and len(groups) == 3 and all(len(g) == 1 for g in groups.values())


def _classes(rows):
    found = {}
    for r in rows:
        found.setdefault((r.pool_id, r.cluster), set()).add(r.model_id)
    return {(k[0], frozenset(v)) for k, v in found.items()}


def test_clusters_of_pools_beyond_one_matrix(spark, monkeypatch):
    """A pair table is clustered like the matrix; small and large pools side by side."""
    source = np.random.default_rng(12)
    centres = np.array([[0, 0], [7, 5], [0, 9], [9, -3]])
    rows = [(k, f"m{i:04d}", (centres[i % 4] + source.normal(0, 0.3, 2)).tolist())
            for k, n in ((0, 12), (1, 260)) for i in range(n)]
    df = spark.createDataFrame(rows, "pool_id int, model_id string, vector array<double>")
    pairs = session.staged(similar.affinities(similar.vector_pairs(df, ["pool_id"]), ["pool_id"], 7))
    want = similar.clusters(pairs, ["pool_id"], 5).collect()
    monkeypatch.setattr(similar, "MAX_POOL", 20)
    got = similar.clusters(pairs, ["pool_id"], 5).collect()
    assert len(got) == 272 and _classes(got) == _classes(want)
    assert {len(c) for k, c in _classes(got) if k == 1} == {65}


def test_leading_eigenvectors_of_a_pair_table_are_those_of_the_matrix():
    source = np.random.default_rng(13)
    a = source.random((200, 200))
    a = a + a.T
    blocks = [np.zeros((200, 0)), np.zeros((200, 0)), source.normal(size=(200, 9)), np.zeros((200, 0)), np.zeros((200, 0))]
    for _ in range(300):
        x, mx, w, p, mp = blocks
        values, *blocks, residual = linalg.ritz_step(x, mx, w, a @ w, p, mp, 9)
        if residual[:5].max() < 1e-8:
            break
    real, vectors = np.linalg.eigh(a)
    np.testing.assert_allclose(values[:5], real[::-1][:5], rtol=1e-9)
    np.testing.assert_allclose(np.abs(blocks[0][:, :5].T @ vectors[:, ::-1][:, :5]), np.eye(5), atol=1e-6)


def test_angle_distance_properties():
    source = np.random.default_rng(9)
    a = np.linalg.qr(source.normal(size=(6, 3)))[0]
    b = np.linalg.qr(source.normal(size=(6, 2)))[0]
    assert abs(linalg.angle_distance(a, a)) < 1e-12
    assert abs(linalg.angle_distance(a, b) - linalg.angle_distance(b, a)) < 1e-12
    turn = np.linalg.qr(source.normal(size=(3, 3)))[0]
    assert abs(linalg.angle_distance(a, a @ turn)) < 1e-12
    whole = np.eye(4)
    assert abs(linalg.angle_distance(whole[:, :2], whole[:, 2:]) - 1.0) < 1e-12
    assert abs(linalg.angle_distance(whole[:, :3], whole[:, :2]) - (1 - 2 / 3)) < 1e-12


def test_shared_information_matches_matrix(spark):
    source = np.random.default_rng(10)
    P = source.random((300, 3))
    P[:, 1] = P[:, 0] * 2
    df = spark.createDataFrame([("a", [float(x) for x in r]) for r in P], "domain string, preds array<double>")
    want = linalg.information_matrix(P, 8)
    for r in similar.shared_information(df, ["domain"], ["0", "1", "2"], 8).collect():
        assert abs(r.shared - want[int(r.i), int(r.j)]) < 1e-9
    assert abs(want[0, 1] - 1) < 1e-9 and want[0, 2] < 0.1


def test_weights_from_moments_match_rows():
    source = np.random.default_rng(11)
    P = source.random((180, 5))
    y = P[:, 0] * 0.7 + P[:, 1] * 0.3 + source.normal(0, 0.02, 180)
    m = linalg.Moments.of_rows(P, y)
    r2, mse = ensemble.accuracies(m)
    np.testing.assert_allclose(r2, [linalg.r2_score(y, p) for p in P.T], atol=1e-9)
    np.testing.assert_allclose(mse, [((y - p) ** 2).mean() for p in P.T], atol=1e-9)
    np.testing.assert_allclose(ensemble.prediction_distances(m), np.sqrt(((P[:, :, None] - P[:, None, :]) ** 2).sum(0)), atol=1e-6)
    w, b = ensemble.weigh("ols", m, None)
    best = np.linalg.lstsq(np.column_stack([P, np.ones(180)]), y, rcond=None)[0]
    np.testing.assert_allclose(np.append(w, b), best, atol=1e-8)
    w, b = ensemble.weigh("ols_perf", m, 4, perf_cull=10.0)
    assert (w[:4] == 0).all() and w[4] != 0
    w, _ = ensemble.weigh("ols_perf", m, None, perf_cull=10.0)     # nothing passes: best three
    assert set(np.flatnonzero(w)) == set(np.argsort(-r2)[:3])
    for kind in ("r2", "mse", "equal"):
        w, b = ensemble.weigh(kind, m, None)
        assert abs(w.sum() - 1) < 1e-12 and b == 0.0
    mi = np.eye(5)
    mi[0, 1] = mi[1, 0] = 0.9
    kept = ensemble.information_cull(np.ones(5, dtype=bool), np.array([0.5, 0.6, 0, 0, 0]), mi, 0.5, None)
    assert kept.tolist() == [False, True, True, True, True]


def test_chains_with_cycle_and_length_three(spark):
    renames = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("p", "q")], "model_id string, sub_id string")
    got = {r.model_id: r.final_id for r in pool.resolve_chains(renames).collect()}
    assert got == {"a": "d", "b": "d", "c": "d", "x": "x", "y": "y", "p": "q"}


def test_long_chains_and_tails_of_cycles(spark):
    links = [(f"m{i}", f"m{i + 1}") for i in range(70)] + [("t2", "t1"), ("t1", "x"), ("x", "y"), ("y", "x")]
    got = {r.model_id: (r.final_id, r.links) for r in pool.resolve_chains(
        spark.createDataFrame(links, "model_id string, sub_id string")).collect()}
    assert got == {f"m{i}": ("m70", 70 - i) for i in range(70)} | {
        "t2": ("x", 2), "t1": ("x", 1), "x": ("x", 2), "y": ("y", 2)}


def test_row_numbers_keep_null_keys_and_buckets(spark):
    rows = [("a", 1, 3), ("a", None, 9), (None, 1, 4), (None, None, 5), ("a", 2, 1)]
    df = spark.createDataFrame(rows, "k string, b int, v int")
    got = sorted((str(r.k), r.v, r.seq) for r in sequence.number_rows(df, ["k"], ["b", "v"], [F.col("b")]).collect())
    assert got == [("None", 4, 2), ("None", 5, 1), ("a", 1, 3), ("a", 3, 2), ("a", 9, 1)]


def test_complete_edges_of_many_streams(spark):
    domains = spark.range(1500).select(F.col("id").cast("string").alias("domain"))
    edges = pool.complete_edges(domains)
    assert edges.distinct().count() == 1500 * 1499 == edges.count()
    domains = spark.range(12).select(F.col("id").cast("string").alias("domain"))
    assert len(set(map(tuple, pool.complete_edges(domains).collect()))) == 12 * 11
    marks = domains.select(F.col("domain").alias("target"), F.lit(2).alias("epoch"))
    models = domains.select(F.col("domain").alias("source"), F.concat_ws("-", "domain", F.lit("0")).alias("model_id"), (F.col("domain").cast("int") % 5).alias("epoch"))
    unread = {r.target: r.unread for r in pool.unread_counts(models, marks).collect()}
    late = [int(d) for d in range(12) if d % 5 > 2]
    assert unread == {str(d): len([x for x in late if x != d]) for d in range(12)}


def test_received_replaced_model_is_active_again(spark):
    boxes = spark.createDataFrame([("t", "s-0", 1, True), ("t", "s-1", 1, False)], "target string, model_id string, epoch int, replaced boolean")
    arrived = spark.createDataFrame([("t", "s-0", 1), ("t", "s-2", 2)], "target string, model_id string, epoch int")
    got = {r.model_id: (r.epoch, r.replaced) for r in pool.store_received(boxes, arrived).collect()}
    assert got == {"s-0": (1, False), "s-1": (1, False), "s-2": (2, False)}


def test_hours_and_schedule(spark):
    rows = spark.createDataFrame([(0,), (30,), (700,), (730,), (745,)], "t int").select(weather.hours(F.col("t")).alias("h")).collect()
    assert [r.h for r in rows] == [0.0, 0.5, 7.0, 7.5, 8.0]
    # a Friday: bounds are strict, wet mornings are warmer, nights end at 23:30
    day = [(t, o, rain) for t, o, rain in ((500, 5.0, 0), (530, 5.0, 0), (530, 5.0, 1), (530, 12.0, 1), (530, 17.0, 0), (2200, 9.0, 1), (2330, 7.0, 0))]
    df = spark.createDataFrame(day, "t int, o double, rain int")
    s = weather.schedule(F.lit("2024-01-05").cast("date"), F.col("t"), F.col("o"), F.col("rain"), 8.0, 12.0)
    got = [(r.s.temp, r.s.on) for r in df.select(s.alias("s")).collect()]
    assert got == [(12.0, 1), (22.0, 1), (24.0, 1), (20.0, 1), (17.0, 0), (14.0, 1), (12.0, 1)]
    house = weather.schedule(F.lit("2024-01-06").cast("date"), F.col("t"), F.col("o"), F.col("rain"), 8.0, 12.0)
    days = spark.createDataFrame([(700, 11.0, 1), (1330, 11.0, 1), (1900, 9.0, 0)], "t int, o double, rain int")
    assert [(r.s.temp, r.s.on) for r in days.select(house.alias("s")).collect()] == [(18.0, 1), (14.0, 1), (20.0, 1)]


def test_normalised_prediction_with_zero_weights(spark):
    df = spark.createDataFrame([([1.0, 3.0], [0.0, 0.0]), ([1.0, 3.0], [3.0, 1.0])], "p array<double>, w array<double>")
    assert [r.v for r in df.select(score.normalised(F.col("p"), F.col("w")).alias("v")).collect()] == [2.0, 1.5]
    with pytest.raises(Exception):
        big = spark.createDataFrame([("a", str(i), [1.0], 0.0) for i in range(5)], "domain string, model_id string, coef array<double>, intercept double")
        score.pooled(big, ["domain"], max_pool=4).collect()


def test_own_distance_and_pools_without_limit(spark):
    vectors = spark.range(1500).select(F.lit("p").alias("pool"), F.format_string("m%04d", "id").alias("model_id"),
                                       F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vector"))
    pairs = similar.vector_pairs(vectors, ["pool"])
    assert pairs.count() == 1500 * 1499 // 2
    row = pairs.filter("i = 'm0007' AND j = 'm1007'").first()
    assert row.d == 1000.0
    own = similar.distance_pairs(vectors.limit(20), ["pool"], "vector", lambda a, b: abs(a[0] - b[0]) / 2)
    assert own.count() == 190 and {r.d for r in own.filter("i = 'm0003' AND j = 'm0009'").collect()} == {3.0}


def test_own_ensemble_reaches_the_tasks(spark, small):
    from driftpool.operators import loop
    from driftpool.sources import tables
    ensemble.register("own_only", lambda p, y, target: (
        np.eye(p.shape[1])[target] if target is not None else np.full(p.shape[1], 1.0 / p.shape[1]), 0.0))
    cfg = LoopConfig(window=30, eps=0.1)
    stream = session.staged(tables.as_stream(tables.line_stream(spark, small)))
    result = session.staged(loop.run(stream, cfg))
    pooled = online.pools(result, pool.complete_edges(stream.select("domain")), cfg, 100)
    got = online.combine(stream, result, pooled, cfg, "own_only").filter("seq > 30")
    assert got.count() > 0 and got.filter("abs(p - p_own) > 1e-12").isEmpty()
    with pytest.raises(ValueError):
        ensemble.register("ols", None)


def test_sweep_copies_and_summary(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "domain string, v double")
    out = sweep.expand(rows, [{"w": 10}, {"w": 20}])
    got = {r.w: (r.streams, r.mean_v) for r in sweep.summarise(out, ["w"], ["v"]).collect()}
    assert got == {10: (2, 2.0), 20: (2, 2.0)}


def test_ensemble_along_streams_matches_brute_force(spark, small):
    """Least squares over own and received models, refitted every half window and after changes."""
    from driftpool.operators import loop
    from driftpool.sources import tables
    cfg = LoopConfig(window=30, eps=0.1)
    stream = session.staged(tables.as_stream(tables.line_stream(spark, small)))
    result = session.staged(loop.run(stream, cfg))
    edges = pool.complete_edges(stream.select("domain"))
    pooled = online.pools(result, edges, cfg, 100)
    whole = online.combine(stream, result, pooled, cfg, "ols").toPandas().set_index(["domain", "seq"])["p"]
    cut = online.combine(stream, result, pooled, cfg, "ols", chunk_rows=128).toPandas().set_index(["domain", "seq"])["p"]
    assert len(whole) == stream.count() and (whole - cut.reindex(whole.index)).abs().max() < 1e-6
    rows = {}
    for r in stream.join(loop.rows_of(result).drop("y"), ["domain", "seq"]).collect():
        rows.setdefault(r.domain, {})[r.seq] = r
    own = {(r.domain, r.model_id): r for r in loop.models_of(result).collect()}
    members = {}
    for r in pooled.collect():
        members.setdefault(r.domain, []).append(r)
    changes = {}
    for r in online.receive_points(result).collect():
        changes.setdefault(r.domain, set()).add(r.seq + 1)
    assert any(len(m) > 3 for m in members.values())
    for d, table in rows.items():
        fit = None
        for s in range(1, len(table) + 1):
            row = table[s]
            if row.model_id is None:
                assert abs(whole[d, s] - row.p) < 1e-9
                continue
            if s in changes[d] or s == 31 or s % 15 == 0 or table[s - 1].model_id != row.model_id:
                back = 30 if s in changes[d] or s <= 31 else 60
                train = [table[k] for k in range(max(1, s - back), s)]
                base = [m for m in members.get(d, []) if m.usable_from <= s and m.model_id != row.model_id]
                base = sorted(base, key=lambda m: (m.usable_from, m.model_id)) + [own[d, row.model_id]]
                P = np.array([[np.dot(t.features, m.coef) + m.intercept for m in base] for t in train])
                fit = (base, *ensemble.weigh("ols", linalg.Moments.of_rows(P, np.array([t.y for t in train])), None))
            base, w, b = fit
            p = sum(v * (np.dot(row.features, m.coef) + m.intercept) for v, m in zip(w, base)) + b
            assert abs(whole[d, s] - p) < 1e-6, (d, s)
    assert math.isfinite(whole.sum())


@pytest.mark.parametrize("evict", ["oldest", "weakest"])
def test_experts_match_row_by_row_decay(spark, evict):
    from driftpool.operators import experts
    source = np.random.default_rng(12)
    n, models = 160, [f"m{i}" for i in range(5)]
    y = source.random(n)
    P = {m: y + source.normal(0.1 * i, 0.3, n) for i, m in enumerate(models)}
    joins = {"m0": 1, "m1": 1, "m2": 40, "m3": 90, "m4": 120}
    rows = [("a", s + 1, m, float(y[s]), float(P[m][s])) for s in range(n) for m in models]
    pairs = spark.createDataFrame(rows, "domain string, seq bigint, model_id string, y double, p double")
    table = spark.createDataFrame([("a", m, t) for m, t in joins.items()], "domain string, model_id string, at bigint")
    for chunk in (7, 1000):
        got = {r.seq: (r.p, r.members) for r in experts.add_experts(pairs, table, evict, size=3, chunk_rows=chunk).collect()}
        w, since = {}, {}
        for s in range(n):
            for m in w:
                w[m] *= 0.8 ** abs(P[m][s - 1] - y[s - 1])
            for m in models:
                if joins[m] == s + 1:
                    while len(w) > 2:
                        gone = min(w, key=(lambda k: (since[k], k)) if evict == "oldest" else (lambda k: (w[k], k)))
                        del w[gone], since[gone]
                    loss = sum(v * abs(P[k][s - 1] - y[s - 1]) for k, v in w.items()) + abs(P[m][s - 1] - y[s - 1])
                    w[m], since[m] = (0.1 * loss if w and s else 1.0), s
            p = sum(v * P[m][s] for m, v in w.items()) / sum(w.values())
            assert abs(got[s + 1][0] - p) < 1e-9 and got[s + 1][1] == len(w)


def test_group_choice_leaves_out_the_tail(spark):
    from driftpool.operators import experts
    rows = []
    for s in range(1, 41):
        y = float(s % 5)
        rows += [("a", s, "own", y, y + (0.5 if s > 30 else 0.0)), ("a", s, "other", y, y + (0.1 if s <= 30 else 0.0))]
    pairs = spark.createDataFrame(rows, "domain string, seq bigint, member string, y double, p double")
    spans = spark.createDataFrame([("a", "own", 1, 40)], "domain string, model_id string, start_seq bigint, end_seq bigint")
    assert experts.group_choice(pairs, spans, 10, 20, chunk_rows=8).first().best_id == "own"
    assert experts.group_choice(pairs, spans, 0, 20, chunk_rows=8).first().substitute
    assert experts.group_choice(pairs, spans, 30, 20).count() == 0


def _offset_rows(spark, offset):
    source = np.random.default_rng(31)
    X = source.normal(size=(400, 3))
    y = X @ [1.5, -0.5, 0.25] + 0.75 + source.normal(0, 0.2, 400)
    rows = [("hot" if i % 4 else None, float(x[0] + offset), float(x[1]), float(x[2]), float(v)) for i, (x, v) in enumerate(zip(X, y))]
    rows += [("hot", None, 1.0, 1.0, 1.0), ("hot", 1.0, 1.0, 1.0, None), ("none", None, 1.0, 1.0, 1.0)]
    return spark.createDataFrame(rows, "domain string, a double, b double, c double, y double"), X, y


@pytest.mark.parametrize("limit", [1, 64 << 20])
def test_centred_moments_keep_large_offsets(spark, limit):
    want = {}
    for offset in (0.0, 1e8):
        df, X, y = _offset_rows(spark, offset)
        stats = gram.centred(df.repartition(7), ["domain"], ["a", "b", "c"], "y", limit)
        for row in gram.solved(stats).collect():
            keep = [i for i in range(400) if (i % 4 > 0) == (row.domain == "hot")]
            w, *_ = np.linalg.lstsq(np.column_stack([X[keep], np.ones(len(keep))]), y[keep], rcond=None)
            p = X[keep] @ w[:3] + w[3]
            r2 = 1 - ((y[keep] - p) ** 2).sum() / ((y[keep] - y[keep].mean()) ** 2).sum()
            assert row.n == len(keep)
            np.testing.assert_allclose(row.coef, w[:3], atol=1e-7)
            assert abs(row.r2 - r2) < 1e-7
            want.setdefault(row.domain, []).append(offset)
    assert want == {"hot": [0.0, 1e8], None: [0.0, 1e8]}


def test_centred_moments_of_many_columns_and_no_rows(spark):
    names = [f"x{i}" for i in range(300)]
    df = spark.range(600).select(F.lit("a").alias("domain"), (F.col("id") * 0.5).alias("y"),
                                 *[F.sin(F.col("id") * (i + 1)).alias(n) for i, n in enumerate(names)])
    row = gram.centred(df, ["domain"], names, "y").first()
    X = np.array([[np.sin(k * (i + 1)) for i in range(300)] for k in range(600)])
    whole = np.column_stack([X, np.arange(600) * 0.5])
    d = whole - whole.mean(0)
    np.testing.assert_allclose(row.products, (d.T @ d)[np.triu_indices(301)], atol=1e-6)
    assert gram.fit(df.limit(0), ["domain"], names[:2], "y").count() == 0
    alone = gram.centred(df.repartition(5), [], names[:2], "y").collect()
    assert [r.n for r in alone] == [600]


def test_shared_information_hands_counts_on(spark):
    source = np.random.default_rng(3)
    rows = [("a" if k % 3 else "b", k, [float(v) for v in source.normal(size=4)]) for k in range(500)]
    df = spark.createDataFrame(rows, "domain string, seq bigint, preds array<double>").repartition(6)
    ids = ["m0", "m1", "m2", "m3"]
    one, many = ({(r.domain, r.i, r.j): r.shared for r in similar.shared_information(df, ["domain"], ids, 8, limit).collect()}
                 for limit in (32 << 20, 1))
    assert len(one) == 24 and one.keys() == many.keys()
    assert all(abs(one[k] - many[k]) < 1e-12 for k in one)


@pytest.mark.parametrize("evict", ["oldest", "weakest"])
def test_experts_of_very_many_joins(spark, evict):
    """A model joins at every row of one stream and predicts 40 rows: 10,000 joins, of which a pool holds ten."""
    from driftpool.operators import experts
    n, life = 10_000, 40
    def p_of(s, m):
        return math.sin(s * 0.1) + ((s * 31 + m * 17) % 100) / 100.0 - 0.5
    models = spark.range(1, n + 1).select(F.lit("a").alias("domain"), F.col("id").alias("at"))
    name = F.format_string("m%05d", "at").alias("model_id")
    pairs = models.withColumn("seq", F.explode(F.sequence(F.greatest(F.col("at") - 1, F.lit(1)), F.least(F.col("at") + life, F.lit(n)))))
    y = F.sin(F.col("seq") * 0.1)
    pairs = pairs.select("domain", "seq", name, y.alias("y"), (y + (F.col("seq") * 31 + F.col("at") * 17) % 100 / 100.0 - 0.5).alias("p"))
    got = {r.seq: (r.p, r.members) for r in experts.add_experts(pairs, models.select("domain", name, "at"), evict).collect()}
    w, lives = {}, lambda s, m: m - 1 <= s <= m + life
    for s in range(1, n + 1):
        off = {m: abs(p_of(s - 1, m) - math.sin((s - 1) * 0.1)) if lives(s - 1, m) and s > 1 else 0.0 for m in [*w, s]}
        for m in w:
            w[m] += math.log(0.8) * off[m]
        while len(w) > 9:
            del w[min(w) if evict == "oldest" else min(w, key=lambda k: (w[k], k))]
        share = 0.1 * (sum(math.exp(v) * off[m] for m, v in w.items()) + off[s])
        w[s] = math.log(share) if w and share > 0 else 0.0
        there = [m for m in w if lives(s, m)]
        top = max(w[m] for m in there)
        p = sum(math.exp(w[m] - top) * p_of(s, m) for m in there) / sum(math.exp(w[m] - top) for m in there)
        assert abs(got[s][0] - p) < 1e-6 and got[s][1] == len(there), s


def test_pools_remember_whom_they_turned_out(spark):
    source = np.random.default_rng(41)
    scores, joins, want = [], [], set()
    for d in ("a", "b", None):
        since, gone = {}, set()
        for at in range(1, 60):
            new = [f"m{at:02d}"] + ([f"n{at:02d}"] if at % 9 == 0 else [])
            mse = {m: float(source.integers(1, 12)) for m in [*since, *gone, *new]}
            mse.pop("m07", None)
            scores += [(d, at, m, v) for m, v in mse.items()] if d else []
            joins += [(d, m, at) for m in new] if d else []
            for m in new:
                if len(since) >= 5:
                    worst = min(since, key=lambda k: (-mse.get(k, math.inf), k))
                    if not mse.get(m, math.inf) < mse.get(worst, math.inf):
                        gone.add(m)
                        continue
                    gone.add(worst)
                    want |= {(d, worst, since.pop(worst), at)} if d else set()
                since[m] = at
        want |= {(d, m, s, None) for m, s in since.items()} if d else set()
    scores = spark.createDataFrame(scores, "domain string, at bigint, model_id string, mse double")
    joins = spark.createDataFrame(joins, "domain string, model_id string, at bigint")
    got = {tuple(r) for r in pool.remembered(scores, joins.unionByName(joins), 5).collect()}
    assert got == want and len({w[3] for w in want}) > 10
    assert pool.remembered(scores.limit(0), joins.limit(0)).count() == 0
    rows = spark.range(1, 41).select(F.lit("a").alias("domain"), F.col("id").alias("seq"))
    moments = spark.createDataFrame([("a", 1), ("a", 13), ("a", 13), ("a", 20), ("a", 41)], "domain string, at bigint")
    taken = sorted((r["at"], r["seq"]) for r in pool.recent_rows(rows, moments, 10).collect())
    assert taken == [(at, s) for at in (13, 20, 41) for s in range(max(at - 10, 1), at)]


def test_weights_of_refits_and_remembered_pools(spark, small):
    """Weights of the last refit give every row's prediction; models turned out take no part again."""
    from driftpool.operators import loop
    from driftpool.sources import tables
    cfg = LoopConfig(window=30, eps=0.1)
    stream = session.staged(tables.as_stream(tables.line_stream(spark, small)))
    result = session.staged(loop.run(stream, cfg))
    pooled = session.staged(online.remember(stream, online.pools(result, pool.complete_edges(stream.select("domain")), cfg, 100), cfg, size=2))
    rows = online.combine(stream, result, pooled, cfg, "accuracy_weighted").collect()
    fits, split = ({(r.domain, r.seq): r for r in online.refits(stream, result, pooled, cfg, "accuracy_weighted", chunk_rows=c).collect()}
                   for c in (1 << 20, 128))
    assert fits.keys() == split.keys()
    models = {(r.domain, r.model_id): r for r in pooled.collect()}
    own = {(r.domain, r.model_id): r for r in loop.models_of(result).collect()}
    spare = {(r.domain, r.model_id): r for r in result.filter("kind = 'temporary'").collect()}
    own = {**spare, **own}
    features = {(r.domain, r.seq): r.features for r in stream.collect()}
    assert any(m.usable_to is not None for m in models.values())
    last = {}
    for r in sorted(rows, key=lambda r: (r.domain, r.seq)):
        if (r.domain, r.seq) in fits:
            last[r.domain] = fits[r.domain, r.seq]
        if r.domain not in last:
            continue
        f, x, p = last[r.domain], features[r.domain, r.seq], 0.0
        for k, w in zip(f.members, f.weights):
            m = models.get((r.domain, k)) or own[r.domain, k]
            if "-" in k:
                assert m.usable_from <= f.seq and (m.usable_to is None or f.seq < m.usable_to)
            p += w * (np.dot(x, m.coef) + m.intercept)
        assert abs(p + f.intercept - r.p) < 1e-6, (r.domain, r.seq)
        np.testing.assert_allclose(f.weights, split[f.domain, f.seq].weights, atol=1e-9)
