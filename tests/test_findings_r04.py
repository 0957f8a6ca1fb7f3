"""Ensembles along streams: nothing is shuffled, named or solved at a size that it need not have."""

import numpy as np
from pyspark.sql import functions as F

from driftpool.functions import linalg
from driftpool.operators import ensemble, loop, online, pool, stream_ops
from driftpool.plans.config import LoopConfig
from driftpool.session import staged


def _input(spark):
    source, rows = np.random.default_rng(31), []
    for domain in ("a", "b"):
        for seq in range(1, 901):
            x = source.random(3)
            rows.append((domain, seq, x.tolist(), float(x[0] if seq // 150 % 2 else 1.0 - x[0])))
    stream = staged(spark.createDataFrame(rows, "domain string, seq long, features array<double>, y double"))
    cfg = LoopConfig(window=20, eps=0.1)
    result = loop.run_bounded(stream, cfg)
    return stream, result, staged(online.pools(result, pool.complete_edges(stream), cfg, 100)), cfg


def test_rows_reach_their_chunk_in_one_shuffle(spark):
    found = online.combine(*_input(spark), "ols", members="none")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(domain" in plan
    assert not [x for x in plan.splitlines() if "hashpartitioning(domain" in x and ", seq" in x]


def test_members_are_named_where_they_start(spark):
    given = _input(spark)
    whole = staged(online.combine(*given, "ols_perf", chunk_rows=256, perf_cull=0.2))
    starts = staged(online.combine(*given, "ols_perf", chunk_rows=256, members="starts", perf_cull=0.2))
    none = online.combine(*given, "ols_perf", chunk_rows=256, members="none", perf_cull=0.2)
    assert none.filter("bases IS NOT NULL").count() == 0
    assert 0 < starts.filter("bases IS NOT NULL").count() < whole.count() / 4
    plain = lambda df: sorted((r.domain, r.seq, r.p, r.n_bases) for r in df.collect())
    assert plain(whole) == plain(starts) == plain(none)
    want = {r.domain: r.changes for r in stream_ops.membership_changes(whole, ["domain"], "bases").collect()}
    for chunk in (256, 8192):
        assert {r.domain: r.changes for r in stream_ops.changes_of_starts(starts, ["domain"], "bases", chunk).collect()} == want
    assert sum(want.values()) > 0


def test_rows_without_a_prediction_or_a_stream_are_left_out(spark):
    stream, result, pooled, cfg = _input(spark)
    odd = spark.createDataFrame([(None, 5, [0.1, 0.2, 0.3], 1.0), ("c", 5, [0.1, 0.2, 0.3], 1.0)], stream.schema)
    want = sorted(map(tuple, online.combine(stream, result, pooled, cfg, "ols").select("domain", "seq", "p").collect()))
    got = online.combine(stream.unionByName(odd), result, pooled, cfg, "ols").select("domain", "seq", "p")
    assert sorted(map(tuple, got.collect())) == want and len(want) == 1800
    # gaps on one side only: rows are those that both have
    some = result.filter("kind <> 'row' OR seq % 7 <> 0")
    assert online.combine(stream, some, pooled, cfg, "ols").agg(F.count("*")).first()[0] == 1800 - 2 * (900 // 7)


def test_weights_in_the_space_of_features(monkeypatch):
    source = np.random.default_rng(32)
    sizes, plain = [], linalg.least_norm
    monkeypatch.setattr(linalg, "least_norm", lambda a, b: sizes.append(len(a)) or plain(a, b))
    for k, d in ((40, 5), (7, 5), (4, 5), (30, 1)):
        x, coef, bias = source.random((180, d)), source.normal(size=(d, k)), source.normal(size=k)
        coef[:, -1] = coef[:, 0]                # the same model twice
        base, y = x @ coef + bias, source.random(180)
        m = linalg.Moments.of_rows(base, y)
        kept = source.random(k) < 0.9
        sizes.clear()
        w, b = ensemble.stacked(m, kept, lines=(x, coef, bias))
        assert sizes[-1] <= min(d, k)
        v, c = ensemble.stacked(m, kept)
        np.testing.assert_allclose(w, v, atol=1e-8)
        np.testing.assert_allclose(base @ w + b, base @ v + c, atol=1e-9)
        w, _ = linalg.ridge_cv(base, y, (0.1, 1.0, 5.0), (x, coef, bias))
        np.testing.assert_allclose(w, linalg.ridge_cv(base, y, (0.1, 1.0, 5.0))[0], atol=1e-9)


def test_information_is_counted_among_models_that_are_left():
    source = np.random.default_rng(33)
    y = source.random(180)
    base = np.column_stack([y + source.normal(0, s, 180) for s in (0.05, 0.06, 0.1, 3.0, 4.0)])
    asked = []
    m = linalg.Moments.of_rows(base, y)
    some = lambda kept: asked.append(len(kept)) or linalg.information_matrix(base[:, kept], 16)
    w, b = ensemble.weigh("ols_information", m, 4, None, some, perf_cull=0.2, mi_cull=0.3)
    v, c = ensemble.weigh("ols_information", m, 4, None, linalg.information_matrix(base, 16), perf_cull=0.2, mi_cull=0.3)
    assert asked == [4] and b == c
    np.testing.assert_array_equal(w, v)


def test_angles_are_computed_once_a_pair(monkeypatch):
    source = np.random.default_rng(34)
    pcs = {k: np.linalg.qr(source.normal(size=(6, 3)))[0].T.tolist() for k in range(12)}
    done, plain, found = [], linalg.angle_distance, online._Angles()
    monkeypatch.setattr(linalg, "angle_distance", lambda a, b: done.append(1) or plain(a, b))
    for names in ([0, 1, 2], [0, 1, 2, 3], list(range(12)), [7, 3, 5], list(range(12))):
        done_before = len(done)
        got = found.among(names, [pcs[k] for k in names])
        fresh = len(done) - done_before
        np.testing.assert_allclose(got, ensemble.angle_matrix([pcs[k] for k in names]), atol=1e-14)
        del done[done_before + fresh:]
    assert len(done) == 66
