"""Keyed loop: against the row-by-row rules, over splits, epochs and streaming."""

import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from driftpool.operators import drift, loop
from driftpool.operators.adaptive import AdaptiveWindow
from driftpool.plans.config import LoopConfig
from driftpool.sources import tables
from tests.rowwise import Buckets, Rowwise

DETECTORS = ("windowed", "adaptive", "combined")


def drifting(seed, n=3000, length=None, noise=0.02):
    source = np.random.default_rng(seed)
    X = source.random((n, 4))
    if length is None:
        cuts = np.sort(source.choice(np.arange(50, n - 50), 12, replace=False))
        concept = np.searchsorted(cuts, np.arange(n)) * 7 % 4
    else:
        concept = np.arange(n) // length % 4
    y = np.select([concept == 0, concept == 1, concept == 2],
                  [X[:, :2].mean(1), 1 - X[:, :2].mean(1), X[:, 2] * 0.9], np.sin(X[:, 1]) * 0.5 + X[:, 3] * 0.5)
    return X, y + source.normal(0, noise, n)


def fed(cfg, X, y, sizes):
    state, out, at = loop.StreamLoop(cfg), ([], [], []), 0
    for size in sizes + [len(y)]:
        if at >= len(y):
            break
        part = slice(at, at + size)
        first, p, runs = state.feed(X[part], y[part])
        assert first == at + 1
        columns = loop.row_columns(first, y[part], p, runs)
        out[0].extend(p), out[1].extend(columns["model_id"]), out[2].extend(state.events)
        state.events = []
        at += size
        state = loop.StreamLoop(cfg, state.dump())
    state.finish()
    return out[0], out[1], out[2] + state.events, state


@pytest.mark.parametrize("detector", DETECTORS)
@pytest.mark.parametrize("seed", range(4))
def test_matches_row_by_row_rules(detector, seed):
    X, y = drifting(seed)
    cfg = LoopConfig(detector=detector, window=40, eps=0.05)
    plain = Rowwise(cfg)
    for x, v in zip(X, y):
        plain.step(x, v)
    plain.finish()
    p, ids, events, state = fed(cfg, X, y, [len(y)])
    assert ids == plain.model_ids
    np.testing.assert_allclose(p, plain.p, rtol=1e-9, atol=1e-9)
    shown = [(e["kind"], e["seq"], e["model_id"]) for e in events
             if e["kind"] in ("learn", "reuse", "temporary", "drift")]
    assert shown == plain.log
    assert len([e for e in events if e["kind"] == "drift"]) > 1
    for k, m in state.memory.models.items():
        assert m.used_for == plain.used[k]
    for a, row in state.memory.moves.items():
        assert {b: n for b, n in row.items() if n} == {b: n for b, n in plain.moves[a].items() if n}
    runs = [(e["model_id"], e["start_seq"], e["end_seq"]) for e in events if e["kind"] == "segment"]
    assert runs == [tuple(r) for r in plain.runs]


@pytest.mark.parametrize("detector", DETECTORS)
def test_split_does_not_matter(detector):
    X, y = drifting(9, 2000)
    cfg = LoopConfig(detector=detector, window=30, eps=0.05)
    whole = fed(cfg, X, y, [len(y)])
    for sizes in ([1] * 300, [7] * 400, [29, 31, 500, 3]):
        part = fed(cfg, X, y, sizes)
        assert part[1] == whole[1]
        np.testing.assert_allclose(part[0], whole[0], rtol=1e-9, atol=1e-12)
        assert [(e["kind"], e["seq"], e["model_id"]) for e in part[2]] == [(e["kind"], e["seq"], e["model_id"]) for e in whole[2]]


@pytest.mark.parametrize("n", [1, 29, 30, 31, 32, 60, 61])
def test_short_streams(n):
    X, y = drifting(1, 200)
    for detector in DETECTORS:
        cfg = LoopConfig(detector=detector, window=30, eps=0.05)
        p, ids, events, _ = fed(cfg, X[:n], y[:n], [n])
        assert len(p) == n and p[:min(n, 30)] == [0.5] * min(n, 30)
        assert ids[:30] == [None] * min(n, 30) and set(ids[30:31]) <= {"0"}


def test_error_equal_to_eps_opens_no_window_and_r2_equal_to_acc_is_no_drift():
    cfg = LoopConfig(window=10, eps=0.5, acc=0.0, learner="flat")
    from driftpool.functions import linalg
    linalg.register_learner("flat", lambda X, y: (np.zeros(X.shape[1]), 0.0))
    X = np.zeros((60, 1))
    y = np.where(np.arange(60) % 2 == 0, 0.5, -0.5)     # errors are exactly eps
    assert not [e for e in fed(cfg, X, y, [60])[2] if e["kind"] == "drift"]
    cfg = LoopConfig(window=10, eps=0.4, acc=0.0, learner="flat")
    assert not [e for e in fed(cfg, X, y, [60])[2] if e["kind"] == "drift"]   # R2 is exactly 0
    cfg = LoopConfig(window=10, eps=0.4, acc=0.01, learner="flat")
    drifts = [e["seq"] for e in fed(cfg, X, y, [60])[2] if e["kind"] == "drift"]
    assert drifts[0] == 12 + 10 - 1                      # first window that can be full


def test_gaps_in_the_numbers_change_nothing_but_the_numbers(spark):
    X, y = drifting(4, 400)
    dense = [("s", i + 1, X[i].tolist(), float(y[i])) for i in range(400)]
    apart = [(d, 3 * n + 7 * (n > 200), x, v) for d, n, x, v in dense]
    kind = "domain string, seq long, features array<double>, y double"
    cfg = LoopConfig(window=30, eps=0.05)
    given = {n: 3 * n + 7 * (n > 200) for n in range(0, 402)}
    plain = loop.run(spark.createDataFrame(dense, kind), cfg).drop("state").collect()
    for result in (loop.run(spark.createDataFrame(apart, kind), cfg),
                   loop.run_bounded(spark.createDataFrame(apart, kind), cfg, epoch_rows=170)):
        got = sorted((r.kind, r.seq, str(r.model_id), r.p) for r in result.collect())
        assert got == sorted((r.kind, given[r.seq], str(r.model_id), r.p) for r in plain)
        spans = sorted((r.start_seq, r.end_seq) for r in result.collect() if r.kind == "segment")
        assert spans == sorted((given[r.start_seq], given[r.end_seq]) for r in plain if r.kind == "segment")


def test_a_registered_learner_reaches_the_tasks(spark):
    from driftpool.functions import linalg
    linalg.register_learner("half", lambda X, y: (np.zeros(X.shape[1]), 0.25))
    rows = [("s", i, [0.0, 1.0], 0.25) for i in range(1, 80)]
    stream = spark.createDataFrame(rows, "domain string, seq long, features array<double>, y double")
    got = loop.rows_of(loop.run(stream, LoopConfig(window=30, learner="half"))).filter("seq > 30").collect()
    assert len(got) == 49 and {r.p for r in got} == {0.25}


def test_constant_label():
    X, y = np.random.default_rng(0).random((200, 2)), np.ones(200)
    for detector in DETECTORS:
        p, _, events, _ = fed(LoopConfig(detector=detector, window=20, eps=0.01), X, y, [200])
        assert not [e for e in events if e["kind"] == "drift"]
        np.testing.assert_allclose(p[20:], 1.0)


@given(st.integers(0, 10_000))
@settings(max_examples=25, deadline=None)
def test_adaptive_window_matches_recomputed_sums(seed):
    source = np.random.default_rng(seed)
    fast, slow = AdaptiveWindow(30, 0.02), Buckets(30, 0.02)
    older, older_slow = AdaptiveWindow(20, 0.02, 6, 5), Buckets(20, 0.02, 6, 5)
    for t in range(400):
        v = float(abs(source.normal(0.1 if t < 150 + seed % 100 else 0.8, 0.1)))
        for a, b in ((fast, slow), (older, older_slow)):
            got, want = a.add(v), b.add(v)
            assert (got[0] if got else None) == want
            assert a.width == sum(len(x) for x in b.items)
    values = [v for b in slow.items for v in b]
    assert math.isclose(fast.spread, np.var(values) * len(values), rel_tol=1e-6, abs_tol=1e-9)


def test_adaptive_window_ignores_constant_input():
    window = AdaptiveWindow(10, 0.02)
    assert all(window.add(0.3) is None for _ in range(500))
    assert sum(len(level) for level in window.levels) <= 2 * 10


def _sorted(df):
    return sorted(df.collect(), key=str)


@pytest.mark.parametrize("detector", DETECTORS)
def test_batch_epochs_and_partitions_agree(spark, small, detector):
    stream = tables.as_stream(tables.line_stream(spark, small))
    cfg = LoopConfig(detector=detector, window=30, eps=0.1)
    whole = loop.run(stream, cfg).filter("kind <> 'state'").drop("state")
    epochs = loop.run_in_epochs(stream, cfg, 170).drop("state")
    a, b = _sorted(whole.drop("coef", "intercept", "p", "pcs")), _sorted(epochs.drop("coef", "intercept", "p", "pcs").select(
        whole.drop("coef", "intercept", "p", "pcs").columns))
    assert a == b
    p = {(r.domain, r.seq): r.p for r in whole.filter("kind = 'row'").collect()}
    q = {(r.domain, r.seq): r.p for r in epochs.filter("kind = 'row'").collect()}
    assert p.keys() == q.keys()
    assert max(abs(p[k] - q[k]) for k in p) < 1e-9


def test_first_drift_equals_window_query(spark, small):
    from driftpool.operators.score import score_pool
    stream = tables.as_stream(tables.line_stream(spark, small))
    cfg = LoopConfig(window=30, eps=0.1)
    result = loop.run(stream, cfg)
    first = loop.models_of(result).filter("model_id = '0'").select("domain", "coef", "intercept")
    rows = score_pool(stream, first).select("domain", "seq", "y", "p")
    fixed = drift.drift_points(rows, ["domain"], 30, 0.1, 0.5, chunk_rows=64).groupBy("domain").agg(F.min("drift_at").alias("at"))
    looped = result.filter("kind = 'drift'").groupBy("domain").agg(F.min("seq").alias("at"))
    assert {(r.domain, r["at"]) for r in fixed.collect()} == {(r.domain, r["at"]) for r in looped.collect()}


def test_segments_tile_the_stream(spark, small):
    stream = tables.as_stream(tables.line_stream(spark, small))
    result = loop.run(stream, LoopConfig(window=30, eps=0.1))
    runs = loop.segments_of(result).orderBy("domain", "start_seq").collect()
    for a, b in zip(runs, runs[1:]):
        if a.domain == b.domain:
            assert b.start_seq == a.end_seq + 1
    known = {(r.domain, r.model_id) for r in loop.models_of(result).collect()}
    assert {(r.domain, r.model_id) for r in runs} <= known


def test_loop_plan_has_one_sort_after_the_stream_shuffle(spark):
    stream = spark.createDataFrame([("a", 1, [0.1], 0.2)], "domain string, seq bigint, features array<double>, y double")
    plan = loop.run(stream, LoopConfig())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1
