"""Queries that run the keyed loop and ensembles along streams."""

import numpy as np
from pyspark.sql import functions as F

from driftpool.functions import linalg, metrics
from driftpool.operators import drift, loop, online, pool, score, stream_ops
from driftpool.plans import sweep
from driftpool.plans.catalog import query
from driftpool.plans.catalog.common import LINE, r
from driftpool.plans.config import LoopConfig
from driftpool.session import staged
from driftpool.sources import tables

LOOP_START = f"""WITH {LINE}
SELECT domain, seq, true AS no_model, round(x1, 6) AS p FROM stream WHERE seq <= 90"""
EPS = 0.1
EPOCH_ROWS = 1000


def _stream(spark, folder):
    return tables.as_stream(tables.line_stream(spark, folder))


def _report(result):
    rows = result.filter("kind = 'row'")
    accuracy = rows.groupBy("domain").agg(
        F.count("*").alias("n"), r(metrics.r2("y", "p"), 4).alias("r2"), r(metrics.rmse("y", "p"), 4).alias("rmse"),
        r(metrics.mae("y", "p"), 4).alias("mae"), r(metrics.pearson("y", "p"), 4).alias("pearson"))
    counts = result.filter("kind <> 'row'").groupBy("domain").pivot(
        "kind", ["learn", "reuse", "temporary", "drift", "publish", "segment"]).count().na.fill(0)
    return accuracy.join(counts, "domain")


def _detector(name, detector):
    @query(name)
    def run(spark, folder):
        return _report(loop.run_bounded(_stream(spark, folder), LoopConfig(detector=detector, eps=EPS)))
    run.__doc__ = f"Whole loop with the {detector} detector: accuracy and events by stream."
    return run


_detector("windowed_loop", "windowed")
_detector("adaptive_loop", "adaptive")
_detector("combined_loop", "combined")


@query("older_adaptive_loop")
def older_adaptive_loop(spark, folder):
    """Adaptive detector with more buckets per level and shorter sides."""
    cfg = LoopConfig(detector="adaptive", eps=EPS, max_buckets=6, min_side=5)
    return _report(loop.run_bounded(_stream(spark, folder), cfg))


@query("user_loops")
def user_loops(spark, folder):
    """Many short streams: one per user, the value of an event from its clock time."""
    rows = tables.event_rows(spark, folder, "user_id")
    stream = rows.select("domain", "seq", F.array(
        F.hour("ts") / 24.0, F.minute("ts") / 60.0, F.lit(1.0) * (F.col("event_type") == "error").cast("int")).alias("features"),
        (F.col("value") / 100.0).alias("y"))
    return _report(loop.run_bounded(stream, LoopConfig(window=20, eps=EPS)))


@query("loop_segments")
def loop_segments(spark, folder):
    return loop.segments_of(loop.run_bounded(_stream(spark, folder), LoopConfig(eps=EPS)))


@query("loop_transitions")
def loop_transitions(spark, folder):
    return loop.transitions_of(loop.run_bounded(_stream(spark, folder), LoopConfig(eps=EPS)))


@query("learned_models")
def learned_models(spark, folder):
    return loop.models_of(loop.run_bounded(_stream(spark, folder), LoopConfig(eps=EPS, components=True)))


@query("loop_in_epochs")
def loop_in_epochs(spark, folder):
    """The loop cut into epochs whose state travels through tables."""
    cfg = LoopConfig(eps=EPS)
    stream = _stream(spark, folder)
    longest = stream.groupBy("domain").count().agg(F.max("count")).first()[0]
    return _report(loop.run_in_epochs(stream, cfg, (longest + 2) // 3))


@query("column_default", LOOP_START)
def column_default(spark, folder):
    """Burn-in of the loop when a feature is the default prediction."""
    rows = tables.line_stream(spark, folder)
    stream = rows.select("domain", "seq", F.array(*tables.FEATURES).alias("features"), "y", F.col("x1").alias("default"))
    cfg = LoopConfig.of("heating", eps=EPS)
    result = loop.rows_of(loop.run_bounded(stream, cfg)).filter(F.col("seq") <= cfg.window)
    return result.select("domain", "seq", F.col("model_id").isNull().alias("no_model"), r(F.col("p"), 6).alias("p"))


def label_mean(x, y):
    """The plainest learner: the mean label of its rows, whatever the features."""
    return np.zeros(x.shape[1]), float(y.mean())


@query("own_learner", f"""WITH {LINE},
first AS (SELECT domain, avg(y) AS m FROM stream WHERE seq <= 90 GROUP BY domain HAVING count(*) > 90 OR max(seq) = 90)
SELECT s.domain, 91 AS seq, round(m, 6) + 0.0 AS p FROM first f JOIN stream s ON s.domain = f.domain AND s.seq = 91""")
def own_learner(spark, folder):
    """First prediction of the loop under a learner that the caller registers."""
    linalg.register_learner("label_mean", label_mean)
    result = loop.rows_of(loop.run_bounded(_stream(spark, folder), LoopConfig(eps=EPS, learner="label_mean")))
    return result.filter("seq = 91").select("domain", F.col("seq").cast("int").alias("seq"), r(F.col("p"), 6).alias("p"))


@query("biased_scores", f"""WITH {LINE} SELECT domain, seq, round(0.5 + 2 * x1 - x2, 6) + 0.0 AS p FROM stream""")
def biased_scores(spark, folder):
    """Rows scored by coefficients of which the first belongs to the bias column."""
    rows = tables.line_stream(spark, folder)
    features = score.biased(F.array("x1", "x2"))
    coef = F.array(F.lit(0.5), F.lit(2.0), F.lit(-1.0))
    return rows.select("domain", "seq", r(score.linear(features, coef, F.lit(0.0)), 6).alias("p"))


@query("parameter_sweep")
def parameter_sweep(spark, folder):
    """One keyed job over all streams and settings, compared afterwards."""
    configs = {n: LoopConfig(eps=EPS, learner=n) for n in ("ridge", "ols", "elastic_following")}
    copies = sweep.expand(_stream(spark, folder), [{"learner": n} for n in configs])
    copies = copies.withColumn("domain", F.concat_ws("@", "domain", "learner"))
    rows = loop.run_bounded(copies, lambda domain: configs[domain.rsplit("@", 1)[1]]).filter("kind = 'row'")
    results = rows.groupBy("domain").agg(metrics.r2("y", "p").alias("r2"), metrics.mae("y", "p").alias("mae"))
    named = results.withColumn("learner", F.substring_index("domain", "@", -1))
    out = sweep.summarise(named, ["learner"], ["r2", "mae"])
    return out.select("learner", "streams", *[r(F.col(c), 4).alias(c) for c in out.columns[2:]])


def _combined(spark, folder, kind, members, **limits):
    cfg = LoopConfig(eps=EPS, components="angles" in kind)
    stream = staged(_stream(spark, folder))
    result = loop.run_bounded(stream, cfg)
    edges = pool.complete_edges(stream.select("domain"))
    return stream, result, edges, cfg, online.combine(
        stream, result, online.pools(result, edges, cfg, EPOCH_ROWS), cfg, kind, members=members, **limits)


def _ensemble(name, kind, **limits):
    @query(name)
    def run(spark, folder):
        rows = _combined(spark, folder, kind, "none", **limits)[-1]
        return rows.groupBy("domain").agg(
            F.count("*").alias("n"), r(metrics.r2("y", "p"), 4).alias("r2"), r(metrics.r2("y", "p_own"), 4).alias("r2_own"),
            r(metrics.mae("y", "p"), 4).alias("mae"), r(metrics.mae("y", "p_own"), 4).alias("mae_own"),
            F.max("n_bases").alias("largest"), r(F.avg("n_bases"), 4).alias("mean_bases"))
    run.__doc__ = f"Ensemble {kind} along every stream, next to the own models."
    return run


_ensemble("ols_ensemble", "ols")
_ensemble("ridge_cv_ensemble", "ridge_cv")
_ensemble("non_negative_ensemble", "non_negative")
_ensemble("perf_cull_ensemble", "ols_perf", perf_cull=0.2)
_ensemble("information_cull_ensemble", "ols_information", perf_cull=0.2, mi_cull=0.2)
_ensemble("angle_cull_ensemble", "ols_angles", perf_cull=0.2, angle=0.4)
_ensemble("cluster_ensemble", "ols_cluster_angles")
_ensemble("prediction_cluster_ensemble", "ols_clusters")
_ensemble("accuracy_weighted_ensemble", "accuracy_weighted")


@query("result_rows")
def result_rows(spark, folder):
    """One result row per stream: ensemble, own models, membership and traffic."""
    stream, result, edges, cfg, rows = _combined(spark, folder, "ols_perf", "starts", perf_cull=0.2)
    rows = staged(rows)
    both = rows.groupBy("domain").agg(
        F.count("*").alias("n"), r(metrics.r2("y", "p"), 4).alias("r2"), r(metrics.rmse("y", "p"), 4).alias("rmse"),
        r(metrics.mae("y", "p"), 4).alias("mae"), metrics.pearson("y", "p").alias("pearson"),
        r(metrics.r2("y", "p_own"), 4).alias("own_r2"), r(metrics.rmse("y", "p_own"), 4).alias("own_rmse"),
        F.max("n_bases").alias("largest"), F.avg("n_bases").alias("mean_size"))
    both = both.withColumn("pearson_p", metrics.pearson_p("pearson", F.col("n").cast("double")))
    both = both.select(*[c for c in both.columns if c not in ("largest", "mean_size")], "largest", "mean_size")
    changes = stream_ops.changes_of_starts(rows, ["domain"], "bases")
    used = online.traffic_of(result, edges, EPOCH_ROWS)
    counts = result.filter("kind <> 'row'").groupBy("domain").pivot("kind", ["learn", "reuse", "drift", "publish"]).count().na.fill(0)
    return (both.join(changes, "domain").join(counts, "domain").join(used, "domain", "left").na.fill(0)
            .withColumn("detector", F.lit(cfg.detector)).withColumn("window", F.lit(cfg.window)))


@query("fixed_and_loop_drifts")
def fixed_and_loop_drifts(spark, folder):
    """First drift of each stream: window query on the first model's predictions, and the loop."""
    cfg = LoopConfig(eps=EPS)
    result = loop.run_bounded(_stream(spark, folder), cfg)
    stream = _stream(spark, folder)
    first = loop.models_of(result).filter("model_id = '0'").select("domain", "coef", "intercept")
    from driftpool.operators.score import score_pool
    rows = score_pool(stream, first).select("domain", "seq", "y", "p")
    fixed = drift.drift_points(rows, ["domain"], cfg.window, cfg.eps, cfg.acc).groupBy("domain").agg(F.min("drift_at").alias("fixed"))
    looped = result.filter("kind = 'drift'").groupBy("domain").agg(F.min("seq").alias("looped"))
    return fixed.join(looped, "domain", "full")
