"""Cases that the third round found, on rows of their own."""

import math

import numpy as np

from driftpool.functions import linalg
from driftpool.operators import stream_ops


def test_active_set_that_comes_back_settles():
    for seed in (378, 795, 808):
        rng = np.random.default_rng(seed)
        k, z = rng.integers(2, 14), rng.random((180, 5))
        w = rng.normal(size=(5, k)) * 0.3
        w[:, k // 2:] = w[:, :k - k // 2] + rng.choice([0, 1e-9, 1e-7, 1e-6, 1e-5, 1e-4]) * rng.normal(size=(5, k - k // 2))
        x = z @ w + rng.choice([0, 0.5]) * rng.random(k)
        y = np.clip(z[:, :3].mean(axis=1) + 0.01 * rng.normal(size=180), 0, 1)
        found, _ = linalg.non_negative(linalg.Moments.of_rows(x, y), 2000)
        assert (found >= 0).all()
        # no column could lower the error any more
        assert (x.T @ (y - x @ found) <= 1e-6 * (1 + np.abs(x.T @ y).max())).all()


def test_shares_of_weights_that_sum_to_nothing(spark):
    rows = spark.createDataFrame([("a", "m", 0.0), ("a", "n", 0.0), ("b", "m", 1.0), ("b", "n", 3.0),
                                  ("c", "m", 2.0), ("c", "n", -2.0), ("d", "m", None)], "domain string, model_id string, weight double")
    found = {(r.domain, r.model_id): r.share for r in stream_ops.weight_shares(rows, ["domain"]).collect()}
    assert math.isnan(found["a", "m"]) and math.isnan(found["a", "n"])
    assert (found["b", "m"], found["b", "n"]) == (0.25, 0.75)
    assert (found["c", "m"], found["c", "n"], found["d", "m"]) == (math.inf, -math.inf, None)


def test_shuffles_of_long_streams_have_more_tasks(spark, monkeypatch):
    """Numbering and rolling windows deal long streams out to as many tasks as their rows need."""
    from pyspark.sql import functions as F

    from driftpool.operators import drift
    from driftpool.plans import sequence
    monkeypatch.setattr(sequence, "TASK_ROWS", 100)
    rows = spark.range(5000).select(
        F.when(F.col("id") % 10 > 0, F.concat(F.lit("s"), F.col("id") % 3)).alias("domain"), (F.col("id") * 7919 % 5000).alias("at"),
        F.sin("id").alias("y"), F.cos("id").alias("p"))
    numbered = sequence.number_rows(rows, ["domain"], ["at"], [F.floor(F.col("at") / 50)])
    assert numbered.rdd.getNumPartitions() >= 50
    streams = {}
    for r in numbered.collect():
        streams.setdefault(r.domain, []).append((r.at, r.seq, r.y, r.p))
    assert len(streams) == 4 and sum(map(len, streams.values())) == 5000
    for found in streams.values():
        assert [s for _, s, _, _ in sorted(found)] == list(range(1, len(found) + 1))
    rolled = drift.rolling_r2(numbered.filter("domain = 's1'"), ["domain"], 30, 64)
    values = {r.seq: r.window_r2 for r in rolled.collect()}
    y, p = (np.array([v[k] for v in sorted(streams["s1"])]) for k in (2, 3))
    assert len(values) == len(y)
    for s in (1, 40, 64, len(y) - 29):
        assert math.isclose(values[s], linalg.r2_score(y[s - 1:s + 29], p[s - 1:s + 29]), rel_tol=1e-9)
    assert values[len(y) - 28] is None


def test_tasks_of_the_loop_follow_its_rows(spark, monkeypatch):
    """Streams of an epoch and the join behind an ensemble are dealt out to as many tasks as their rows need."""
    from driftpool.operators import loop, online, pool
    from driftpool.plans import sequence
    from driftpool.plans.config import LoopConfig
    from pyspark.sql import functions as F
    monkeypatch.setattr(sequence, "TASK_ROWS", 25)
    rows = spark.range(2000).select(
        F.concat(F.lit("s"), F.col("id") % 40).alias("domain"), (F.floor(F.col("id") / 40) + 1).alias("seq"),
        F.array(F.sin("id"), F.cos("id")).alias("features"), F.sin(F.col("id") * 3).alias("y"))
    assert loop.in_order(rows, rows.count()).rdd.getNumPartitions() == 80
    cfg = LoopConfig(window=10, eps=0.1)
    result = loop.run(rows, cfg)
    key = lambda t: sorted(map(str, t.select("domain", "kind", "seq", "y", F.round("p", 8), "model_id").collect()))
    assert key(result) == key(loop.run_in_epochs(rows, cfg, 20))
    edges = pool.complete_edges(rows.select("domain"))
    plain = lambda t: sorted((r.domain, r.seq, round(r.p, 8)) for r in t.select("domain", "seq", "p").collect())
    pools = online.pools(result, edges, cfg, 20)
    found = plain(online.combine(rows, result, pools, cfg, "ols"))
    monkeypatch.setattr(sequence, "TASK_ROWS", 10 ** 6)
    assert found == plain(online.combine(rows, result, pools, cfg, "ols")) and len(found) == 2000


def test_near_copies_take_pairs_in_proportion(spark, monkeypatch):
    """SimHashes give candidates, and a group whose first text is like none of the others is not compared pair by pair."""
    from driftpool.llm import simhash
    words = [f"w{k}" for k in range(100)]
    places = [k for k in range(5, 95) if k not in (30, 60)]
    change = lambda *at: " ".join(f"z{k}" if k in at else w for k, w in enumerate(words))
    docs = spark.createDataFrame(list(enumerate([change(30, 60), *map(change, places)])), "doc_id long, text string").coalesce(1)
    compared, printed, stage = [], [], simhash.staged

    def counted(df):
        kept = stage(df)
        if kept.columns == ["a", "b"]:
            compared.append(kept.count())
        return kept
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda *given: printed.append(given) or links(*given))
    monkeypatch.setattr(simhash, "staged", counted)
    assert sorted(r.doc_id for r in simhash.deduplicated(docs).collect()) == [0, 1]
    assert len(printed) == 1 and 0 < sum(compared) < len(places) * 35
    rows = spark.createDataFrame([(1, 0), (2, 0), (3, 7), (4, 255), (5, 1 << 40)], "node long, fp long")
    assert {(r.a, r.node) for r in simhash._printed(rows).collect()} >= {(1, 2)}
    found = {frozenset((r.a, r.node)) for r in simhash._printed(rows).collect()}
    assert found == {frozenset(p) for p in ((1, 2), (1, 3), (1, 5))}


def test_experts_write_sums_and_not_their_pairs(spark, monkeypatch):
    """Pairs are summed up where they are; blank predictions blank the rows of their period, unnamed models have none."""
    from driftpool.operators import experts
    from driftpool.session import staged
    from pyspark.sql import functions as F
    written = []

    def counted(df):
        kept = staged(df)
        written.append(kept.count())
        return kept
    monkeypatch.setattr(experts, "staged", counted)
    models = spark.createDataFrame([("a", 1), ("b", 1), ("c", 41)], "model_id string, at long")
    rows = spark.range(1, 2001).select("id", F.sin("id").alias("y")).crossJoin(models)
    blank = (F.col("id") == 700) & (F.col("model_id") == "b")
    pairs = rows.select(F.lit("s").alias("domain"), F.col("id").alias("seq"), "model_id", "y",
                        F.when(~blank, F.col("y") + F.col("id") * F.ascii("model_id") % 13 / 100.0).alias("p"))
    more = [pairs.filter("seq < 9").withColumn(c, F.lit(None).cast("string")) for c in ("domain", "model_id")]
    joins = models.select(F.lit("s").alias("domain"), "model_id", "at")
    given = pairs.unionByName(more[0]).unionByName(more[1])
    found = {r.seq: r for r in experts.add_experts(given, joins, size=2, chunk_rows=250).collect()}
    assert max(written) < 100       # before: every pair
    assert len(found) == 2000 and {r.members for r in found.values()} == {2}
    assert [s for s in found if found[s].p is None] == [700]
    off = lambda m, s: 0.0 if (m, s) == ("b", 700) else s * ord(m) % 13 / 100.0
    w = {"a": 0.0, "b": 0.0}
    for s in range(1, 2001):
        if s == 41:
            del w["a"]
            w["c"] = math.log(0.1 * (math.exp(w["b"]) * off("b", 40) + off("c", 40)))
        if s != 700:
            p = sum(math.exp(v) * (math.sin(s) + off(m, s)) for m, v in w.items()) / sum(map(math.exp, w.values()))
            assert abs(found[s].p - p) < 1e-9 and math.isclose(found[s].y, math.sin(s))
        w = {m: v + math.log(0.8) * off(m, s) for m, v in w.items()}
    first = given.withColumn("p", F.when((F.col("seq") != 1) | (F.col("model_id") != "a"), F.col("p")))
    found = experts.add_experts(first, joins, size=2, chunk_rows=16).filter("p IS NULL").collect()
    assert {r.seq for r in found} == {*range(1, 41), 700}


def test_insensitive_fits_of_many_windows_at_once(spark, monkeypatch):
    """Windows are fitted together, each as it is alone; a fit that does not settle is still an error."""
    import pytest
    from driftpool.plans.catalog import models
    from pyspark.sql import functions as F
    rng = np.random.default_rng(3)
    X = rng.random((40, 90, 5))
    y = np.where(np.arange(40)[:, None] % 2, np.sin(X[..., 0]) + X[..., 3], X[..., :3].mean(axis=2)) + rng.normal(0, 0.01, (40, 90))
    coef, intercept = linalg.insensitive_many(X, y, 1.0, 0.01)
    for k in range(40):
        w, b = linalg.insensitive(X[k], y[k], 1.0, 0.01)
        assert np.allclose(coef[k], w, rtol=0, atol=1e-9) and math.isclose(intercept[k], b, abs_tol=1e-9)
    with pytest.raises(ArithmeticError):
        linalg.insensitive_many(X, y, 1.0, 0.01, rounds=3)
    monkeypatch.setattr(models, "WINDOWS", 8)
    rows = spark.range(1000).select(
        F.when(F.col("id") % 3 > 0, F.lit("a")).alias("domain"), F.floor(F.col("id") / 270).alias("block"),
        F.array(F.sin("id"), F.cos(F.col("id") * 7)).alias("features"), F.sin(F.col("id") * 3).alias("y"))
    found = {(r.domain, r.block): r for r in models.window_fits(rows, ["domain", "block"], "insensitive").collect()}
    assert len(found) == 8 and sum(r.n for r in found.values()) == 1000
    part = rows.filter("domain = 'a' AND block = 3").toPandas()
    w, b = linalg.insensitive(np.stack(part["features"].to_numpy()), part["y"].to_numpy(), 1.0, 0.01)
    assert np.allclose(found["a", 3].coef, w, atol=1e-5) and abs(found["a", 3].intercept - b) < 1e-5


def test_pairs_of_many_like_buckets_are_made_once(spark):
    """Texts that share a passage meet in each of its shingles: a pair is made in one bucket, none of them is lost."""
    from driftpool.llm import simhash
    from pyspark.sql import functions as F
    rng = np.random.default_rng(5)
    keys = {n: {int(k) for k in rng.choice(90, 70 if n < 6 else 20, replace=False)} for n in range(40)}
    roots = {n: 3 * (n // 3) if n % 2 else n for n in range(40)}
    members = spark.createDataFrame([(k, n, roots[n]) for n in keys for k in keys[n]], "key long, node long, root long")
    open_ = members.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(
        F.max_by("root", F.struct("c", "root")).alias("main"), F.sum("c").alias("many"), F.max("c").alias("most")).filter("most < many")
    marked = spark.createDataFrame([(n, 100, [0] * simhash.PARITY) for n in keys], "node long, n long, parity array<long>")
    found = [(r.a, r.b) for r in simhash._unmet(members, open_, marked, 0.8).collect()]
    want = {(a, b) for a in keys for b in keys if a < b and roots[a] != roots[b] and keys[a] & keys[b]}
    assert set(found) == want
    long = {n for n in keys if len(keys[n]) > simhash.KNOWN}        # only their least keys are looked through
    assert len(long) == 6 and len([p for p in found if not set(p) & long]) == len([p for p in want if not set(p) & long])
    leads = members.groupBy("key").agg(F.array(F.min("node"), F.max("node") % 7).alias("leads"))
    drawn = {r.key: r.leads for r in leads.collect()}
    met = [(r.a, r.node) for r in simhash._led(members, leads).collect()]
    assert sorted(met) == sorted({(a, n) for n in keys for k in keys[n] for a in drawn[k] if a != n})


def test_dropped_stores_of_workers_are_given_back(monkeypatch):
    """A worker that goes on to another operator returns the memory of what it kept for the last one."""
    from driftpool.llm import bounds
    given, give_back = [], bounds._give_back
    monkeypatch.setattr(bounds, "_stores", {})
    monkeypatch.setattr(bounds, "_give_back", lambda: given.append(sorted(bounds._stores)) or give_back())
    bounds.worker_store("encoder")["words"] = [str(k) * 20 for k in range(1000)]
    assert bounds.worker_store("encoder")["words"][1] == "1" * 20 and not given
    assert bounds.worker_store("simhash") == {} and given == [[]]
    assert bounds.worker_store("simhash") == {} and len(given) == 1 and list(bounds._stores) == ["simhash"]
