"""Queries on fits, pool scoring and ensemble weights."""

import numpy as np
from pyspark.sql import functions as F

from driftpool.functions import linalg, metrics
from driftpool.operators import ensemble, gram, score
from driftpool.plans import config
from driftpool.plans.catalog import query
from driftpool.plans.catalog.common import (LINE, POOL, R2, WINDOW, big, first_models, pool_predictions, r,
                                            wide_predictions)
from driftpool.session import join_bounded, staged
from driftpool.sources import tables

POOL_SIZE = 10
POOL_IDS = [f"m{i}" for i in range(POOL_SIZE)]

SUMS = LINE + """,
sums AS (
  SELECT domain, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my,
         covar_pop(x1, x1) * count(*) AS c11, covar_pop(x1, x2) * count(*) AS c12, covar_pop(x2, x2) * count(*) AS c22,
         covar_pop(x1, y) * count(*) AS c1, covar_pop(x2, y) * count(*) AS c2,
         sum(x1 * x1) AS r11, sum(x1 * x2) AS r12, sum(x2 * x2) AS r22, sum(x1 * y) AS r1, sum(x2 * y) AS r2
  FROM stream GROUP BY domain)"""


def _two(models):
    return models.select("domain", r(F.col("coef")[0]).alias("w1"), r(F.col("coef")[1]).alias("w2"),
                         r(F.col("intercept")).alias("b"))


@query("first_models", f"""WITH {SUMS.replace('FROM stream GROUP BY', f'FROM stream WHERE seq <= {WINDOW} GROUP BY')}, w AS (
  SELECT domain, (c1 * c22 - c2 * c12) / (c11 * c22 - c12 * c12) AS w1,
         (c2 * c11 - c1 * c12) / (c11 * c22 - c12 * c12) AS w2, m1, m2, my FROM sums)
SELECT domain, round(w1, 6) + 0.0 AS w1, round(w2, 6) + 0.0 AS w2, round(my - w1 * m1 - w2 * m2, 6) + 0.0 AS b FROM w""")
def first_models_(spark, folder):
    return _two(first_models(tables.line_stream(spark, folder)))


@query("ridge_models", f"""WITH {SUMS}, w AS (
  SELECT domain, (c1 * (c22 + 1) - c2 * c12) / ((c11 + 1) * (c22 + 1) - c12 * c12) AS w1,
         (c2 * (c11 + 1) - c1 * c12) / ((c11 + 1) * (c22 + 1) - c12 * c12) AS w2, m1, m2, my FROM sums)
SELECT domain, round(w1, 6) + 0.0 AS w1, round(w2, 6) + 0.0 AS w2, round(my - w1 * m1 - w2 * m2, 6) + 0.0 AS b FROM w""")
def ridge_models(spark, folder):
    return _two(gram.fit(tables.line_stream(spark, folder), ["domain"], ["x1", "x2"], "y", "ridge", alpha=1.0))


@query("kernel_ridge_models", f"""WITH {SUMS}
SELECT domain, round((r1 * (r22 + 3) - r2 * r12) / ((r11 + 3) * (r22 + 3) - r12 * r12), 6) + 0.0 AS w1,
       round((r2 * (r11 + 3) - r1 * r12) / ((r11 + 3) * (r22 + 3) - r12 * r12), 6) + 0.0 AS w2, 0.0::DOUBLE AS b FROM sums""")
def kernel_ridge_models(spark, folder):
    return _two(gram.fit(tables.line_stream(spark, folder), ["domain"], ["x1", "x2"], "y", "kernel_ridge", alpha=3.0))


@query("elastic_models", f"""WITH {SUMS}, w AS (
  SELECT domain, n, m1, my, sqrt(c11) AS s, c1 / sqrt(c11) / n AS pull FROM sums)
SELECT domain, round(sign(pull) * greatest(abs(pull) - 0.001 * 0.7, 0) / (1.0 / n + 0.001 * 0.3) / s, 6) + 0.0 AS w1,
  round(my - m1 * (sign(pull) * greatest(abs(pull) - 0.001 * 0.7, 0) / (1.0 / n + 0.001 * 0.3) / s), 6) + 0.0 AS b FROM w""")
def elastic_models(spark, folder):
    models = gram.fit(tables.line_stream(spark, folder), ["domain"], ["x1"], "y", "elastic", alpha=0.001, l1=0.7)
    return models.select("domain", r(F.col("coef")[0]).alias("w1"), r(F.col("intercept")).alias("b"))


@query("supplier_models", f"""WITH {POOL}
SELECT model_id, round(w, 6) + 0.0 AS w, round(b, 6) + 0.0 AS b, used_for FROM pool""")
def supplier_models(spark, folder):
    """The pool of one-feature models, solved from moments."""
    rows = tables.line_stream(spark, folder).withColumn(
        "model_id", F.concat(F.lit("m"), (F.col("l_suppkey") % 10).cast("string")))
    models = gram.fit(rows, ["model_id"], ["x1"], "y")
    return models.select("model_id", r(F.col("coef")[0]).alias("w"), r(F.col("intercept")).alias("b"),
                         F.col("n").alias("used_for"))


@query("shifted_models", f"""WITH {LINE}
SELECT domain, round(regr_slope(y, x1), 4) + 0.0 AS w, round(regr_r2(y, x1), 4) + 0.0 AS r2, count(*) AS used_for
FROM stream GROUP BY domain""")
def shifted_models(spark, folder):
    """A feature far from zero: slope and R2 are those of the feature without its offset."""
    rows = tables.line_stream(spark, folder).withColumn("x1", F.col("x1") + 2.0 ** 26)
    models = gram.fit(rows, ["domain"], ["x1"], "y", r2=True)
    return models.select("domain", r(F.col("coef")[0], 4).alias("w"), r(F.col("r2"), 4).alias("r2"), F.col("n").alias("used_for"))


def _constants():
    source = np.random.default_rng(7)
    w = source.normal(0.0, np.sqrt(2.0 * 0.5), (3, 2))
    return w, source.uniform(0.0, 2.0 * np.pi, 3)


def _sql_fourier():
    w, b = _constants()
    return ", ".join(f"round(cos({float(b[i])!r} + x1 * {float(w[i, 0])!r} + x4 * {float(w[i, 1])!r}) * sqrt(2.0 / 3), 6) + 0.0 AS f{i}"
                     for i in range(3))


@query("fourier_features", f"WITH {LINE} SELECT domain, seq, {_sql_fourier()} FROM line")
def fourier_features(spark, folder):
    columns = gram.fourier([F.col("x1"), F.col("x4")], 3, 0.5, 7)
    return tables.line_rows(spark, folder).select(
        "domain", big(F.col("seq")).alias("seq"), *[r(c).alias(f"f{i}") for i, c in enumerate(columns)])


@query("fourier_ridge_models")
def fourier_ridge_models(spark, folder):
    rows = tables.line_stream(spark, folder)
    names = [f"f{i}" for i in range(16)]
    columns = gram.fourier([F.col(c) for c in tables.FEATURES], 16, 0.5, 11)
    projected = rows.select("domain", "y", *[c.alias(n) for c, n in zip(columns, names)])
    return gram.fit(projected, ["domain"], names, "y", "ridge", alpha=0.2)


@query("insensitive_models")
def insensitive_models(spark, folder):
    """Epsilon-insensitive fit of every full window of every stream: groups of at most one window."""
    rows = tables.as_stream(tables.line_stream(spark, folder))
    windows = rows.withColumn("block", F.floor((F.col("seq") - 1) / config.WINDOW))
    return window_fits(windows, ["domain", "block"], "insensitive")


WINDOWS = 512      # windows that a group holds


def window_fits(rows, keys, learner):
    """One fit a window of ``keys``, the last of them its number; neighbouring windows are fitted together."""
    *outer, block = keys

    def many(pdf):
        pdf = pdf.sort_values(block, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(pdf[block].to_numpy()) != 0))
        out = pdf[keys].iloc[starts].copy()
        out["n"] = np.diff(np.append(starts, len(pdf)))
        x, y = np.stack(pdf["features"].to_numpy()), pdf["y"].to_numpy(dtype=float)
        coef, intercept = np.empty((len(out), x.shape[1])), np.empty(len(out))
        for n in out["n"].unique():
            found = np.flatnonzero(out["n"] == n)
            at = starts[found][:, None] + np.arange(n)
            coef[found], intercept[found] = linalg.fit_windows(learner, x[at], y[at])
        out["coef"], out["intercept"] = coef.tolist(), intercept
        return out
    types = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys)
    return (rows.groupBy(*outer, F.floor(F.col(block) / WINDOWS).alias("_windows"))
            .applyInPandas(many, f"{types}, n bigint, coef array<double>, intercept double"))


@query("tree_accuracy")
def tree_accuracy(spark, folder):
    """One regression tree over all streams, the stream as a feature; accuracy by stream."""
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor
    rows = tables.line_stream(spark, folder).select("domain", *tables.FEATURES, "y")
    indexed = StringIndexer(inputCol="domain", outputCol="place").fit(rows).transform(rows)
    ready = VectorAssembler(inputCols=["place"] + tables.FEATURES, outputCol="features").transform(indexed)
    tree = DecisionTreeRegressor(featuresCol="features", labelCol="y", maxDepth=10, seed=1).fit(ready)
    return tree.transform(ready).groupBy("domain").agg(
        F.count("*").alias("n"), r(metrics.r2("y", "prediction"), 4).alias("r2"))


SCORES = POOL + f""",
scores AS (
  SELECT domain, model_id, count(*) AS n, avg((y - p) * (y - p)) AS mse,
         {R2} AS r2
  FROM pairs GROUP BY domain, model_id)"""


def _scores(spark, folder):
    return ensemble.scores(pool_predictions(spark, folder), ["domain"])


@query("pool_scores", f"""WITH {SCORES}
SELECT domain, model_id, n, round(r2, 6) + 0.0 AS r2, round(mse, 6) AS mse FROM scores""")
def pool_scores(spark, folder):
    return _scores(spark, folder).select("domain", "model_id", "n", r(F.col("r2")).alias("r2"), r(F.col("mse")).alias("mse"))


@query("mean_of_pool", f"""WITH {POOL}
SELECT domain, seq, round(avg(p), 6) + 0.0 AS p, count(*) AS models FROM pairs GROUP BY domain, seq""")
def mean_of_pool(spark, folder):
    wide = wide_predictions(spark, folder)
    equal = F.transform("preds", lambda _: F.lit(1.0))
    return wide.select("domain", big(F.col("seq")).alias("seq"), r(score.normalised(F.col("preds"), equal)).alias("p"),
                       F.size("preds").cast("bigint").alias("models"))


def _weighted(name, sql, weigh):
    @query(name, sql)
    def run(spark, folder):
        return weigh(_scores(spark, folder)).select("domain", "model_id", r(F.col("weight"), 6).alias("weight"))
    return run


_weighted("r2_weights", f"""WITH {SCORES}
SELECT domain, model_id, round(greatest(r2, 1e-14) / sum(greatest(r2, 1e-14)) OVER (PARTITION BY domain), 6) + 0.0 AS weight FROM scores""",
          lambda s: ensemble.r2_weights(s, ["domain"]))
_weighted("mse_weights", f"""WITH {SCORES}
SELECT domain, model_id, round(1 / mse / sum(1 / mse) OVER (PARTITION BY domain), 6) + 0.0 AS weight FROM scores""",
          lambda s: ensemble.mse_weights(s, ["domain"]))
_weighted("accuracy_weights", f"""WITH {SCORES}
SELECT domain, model_id, round(1 - mse / sum(mse) OVER (PARTITION BY domain), 6) + 0.0 AS weight FROM scores WHERE r2 > 0""",
          lambda s: ensemble.accuracy_weights(s, ["domain"]))
_weighted("equal_weights", f"""WITH {SCORES}
SELECT domain, model_id, round(1.0 / count(*) OVER (PARTITION BY domain), 6) AS weight FROM scores""",
          lambda s: ensemble.equal_weights(s, ["domain"]))


@query("perf_cull", f"""WITH {SCORES}, k AS (
  SELECT *, row_number() OVER (PARTITION BY domain ORDER BY r2 DESC, model_id) AS place,
         count(*) FILTER (WHERE r2 > 0.001) OVER (PARTITION BY domain) AS passed FROM scores)
SELECT domain, model_id, round(r2, 6) + 0.0 AS r2 FROM k WHERE r2 > 0.001 OR (passed = 0 AND place <= 3)""")
def perf_cull(spark, folder):
    kept = ensemble.perf_cull(_scores(spark, folder), ["domain"], 0.001)
    return kept.select("domain", "model_id", r(F.col("r2")).alias("r2"))


@query("decayed_weights", f"""WITH {POOL}, b AS (
  SELECT domain, model_id, (seq - 1) // 1000 AS block, sum(abs(p - y)) AS e FROM pairs GROUP BY 1, 2, 3)
SELECT domain, model_id, block, round(ln(0.8::DOUBLE) * sum(e) OVER (PARTITION BY domain, model_id ORDER BY block), 4) AS log_weight
FROM b""")
def decayed_weights(spark, folder):
    out = ensemble.decayed_weights(pool_predictions(spark, folder), ["domain"], 1000)
    return out.select("domain", "model_id", big(F.col("block")).alias("block"), r(F.col("log_weight"), 4).alias("log_weight"))


@query("joining_weights", f"""WITH {POOL}
SELECT domain, seq, round(0.1 * sum(0.1 * abs(p - y)), 8) + 0.0 AS weight FROM pairs GROUP BY domain, seq""")
def joining_weights(spark, folder):
    pairs = pool_predictions(spark, folder)
    pool = spark.createDataFrame([(m, 0.1) for m in POOL_IDS], "model_id string, weight double")
    loss = ensemble.joining_weight(pairs, pool, ["domain", "seq"])
    return loss.select("domain", big(F.col("seq")).alias("seq"), r(F.col("weight"), 8).alias("weight"))


@query("stacked_models", f"""WITH {SUMS}
SELECT domain, round((c1 * c22 - c2 * c12) / (c11 * c22 - c12 * c12), 6) + 0.0 AS w1,
       round((c2 * c11 - c1 * c12) / (c11 * c22 - c12 * c12), 6) + 0.0 AS w2,
       round(my - (c1 * c22 - c2 * c12) / (c11 * c22 - c12 * c12) * m1 - (c2 * c11 - c1 * c12) / (c11 * c22 - c12 * c12) * m2, 6) + 0.0 AS b
FROM sums""")
def stacked_models(spark, folder):
    """Least squares over two base predictions (each passes one feature through)."""
    wide = tables.line_stream(spark, folder).select("domain", "y", F.array("x1", "x2").alias("preds"))
    stats = ensemble.prediction_moments(wide, ["domain"], 2)
    w = ensemble.weights(stats, ["domain"], "ols")
    return w.select("domain", r(F.col("weights")[0]).alias("w1"), r(F.col("weights")[1]).alias("w2"), r(F.col("intercept")).alias("b"))


@query("stacked_pool", f"""WITH {LINE}, f AS (
  SELECT domain, regr_slope(y, x1) AS w, regr_intercept(y, x1) AS b FROM stream GROUP BY domain)
SELECT s.domain, seq, round(f.w * x1 + f.b, 5) + 0.0 AS p FROM stream s JOIN f ON s.domain = f.domain""")
def stacked_pool(spark, folder):
    """Ten collinear base models: the minimum-norm fit predicts what one regression predicts."""
    wide = wide_predictions(spark, folder)
    stats = ensemble.prediction_moments(wide, ["domain"], POOL_SIZE)
    w = ensemble.weights(stats, ["domain"], "ols")
    rows = join_bounded(wide, w, ["domain"])
    return rows.select("domain", big(F.col("seq")).alias("seq"),
                       r(score.combined(F.col("preds"), F.col("weights"), F.col("intercept")), 5).alias("p"))


@query("weighted_pool_accuracy", f"""WITH {SCORES}, e AS (
  SELECT p.domain, p.seq, any_value(p.y) AS y, sum(p.p * greatest(s.r2, 1e-14)) / sum(greatest(s.r2, 1e-14)) AS p
  FROM pairs p JOIN scores s ON s.domain = p.domain AND s.model_id = p.model_id GROUP BY p.domain, p.seq)
SELECT domain, round({R2}, 6) + 0.0 AS r2,
       round(avg(abs(y - p)), 6) AS mae FROM e GROUP BY domain""")
def weighted_pool_accuracy(spark, folder):
    wide = wide_predictions(spark, folder)
    w = ensemble.weights(ensemble.prediction_moments(wide, ["domain"], POOL_SIZE), ["domain"], "r2")
    rows = join_bounded(wide, w, ["domain"]).withColumn("p", score.normalised(F.col("preds"), F.col("weights")))
    return rows.groupBy("domain").agg(r(metrics.r2("y", "p")).alias("r2"), r(metrics.mae("y", "p")).alias("mae"))


def three_feature_pool(spark, folder):
    """Predictions of ten three-feature models, fitted per group of suppliers."""
    stream = tables.line_stream(spark, folder)
    xs = ["x1", "x2", "x4"]
    named = stream.withColumn("model_id", F.concat(F.lit("m"), (F.col("l_suppkey") % 10).cast("string")))
    models = gram.fit(named, ["model_id"], xs, "y").drop("n").withColumn("pool_id", F.lit(0))
    rows = stream.select("domain", "seq", "y", F.array(*xs).alias("features"), F.lit(0).alias("pool_id"))
    return score.score_wide(rows, models, ["pool_id"]).drop("pool_id", "features")


@query("ensemble_weights")
def ensemble_weights(spark, folder):
    """Weights of every method that needs only accuracies and predictions, from one pass."""
    from driftpool.session import staged
    stats = staged(ensemble.prediction_moments(three_feature_pool(spark, folder), ["domain"], POOL_SIZE))
    kinds = ["ols", "non_negative", "r2", "mse", "ols_perf", "ols_near", "ols_clusters", "accuracy_weighted", "equal"]
    out = None
    for kind in kinds:
        part = ensemble.weights(stats, ["domain"], kind, target=0).withColumn("ensemble", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


@query("angle_weights")
def angle_weights(spark, folder):
    """Weights of the methods that compare models by their principal directions."""
    from driftpool.operators import similar
    stream = tables.line_stream(spark, folder)
    named = stream.withColumn("model_id", F.concat(F.lit("m"), (F.col("l_suppkey") % 10).cast("string")))
    pcs = gram.components(named, ["model_id"], ["x1", "x2", "x4"], "y", 0.3).withColumn("pool_id", F.lit(0))
    bases = similar.packed(pcs, ["pool_id"], "pcs")
    stats = ensemble.prediction_moments(three_feature_pool(spark, folder), ["domain"], POOL_SIZE)
    both = join_bounded(stats.withColumn("pool_id", F.lit(0)), bases, ["pool_id"])
    out = None
    for kind in ("ols_angles", "ols_near_angles", "ols_cluster_angles"):
        part = ensemble.weights(both, ["domain"], kind, target=0, pcs="pcs", angle=0.9).withColumn("ensemble", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


@query("information_weights")
def information_weights(spark, folder):
    """Least squares after culling models that share too much information."""
    from driftpool.operators import similar
    wide = three_feature_pool(spark, folder)
    shared = similar.shared_information(wide, ["domain"], POOL_IDS, 16)
    whole = shared.unionByName(shared.select("domain", F.col("i"), F.col("i").alias("j"), F.lit(1.0).alias("shared")).distinct())
    matrix = whole.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("i", "j", "shared"))).alias("_m")).select(
        "domain", F.col("_m.shared").alias("mi"))
    stats = ensemble.prediction_moments(wide, ["domain"], POOL_SIZE).join(matrix, "domain")
    return ensemble.weights(stats, ["domain"], "ols_information", target=0, mi="mi", mi_cull=0.5)


@query("group_choice", f"""WITH {POOL}, run AS (
  SELECT domain, concept, (seq - 1) // 500 AS k, min(seq) AS start_seq, max(seq) AS end_seq FROM stream GROUP BY 1, 2, 3),
sc AS (
  SELECT p.domain, r.concept, r.start_seq, p.model_id AS member, count(*) AS n,
         {R2} AS r2
  FROM pairs p JOIN run r ON r.domain = p.domain AND p.seq BETWEEN r.start_seq AND r.end_seq - 90 GROUP BY 1, 2, 3, 4)
SELECT domain, 'm' || concept AS model_id, start_seq, max_by(member, (r2, member)) AS best_id, round(max(r2), 6) + 0.0 AS r2,
       CAST(max_by(member, (r2, member)) <> 'm' || concept AS INTEGER) AS substitute
FROM sc WHERE n >= 90 GROUP BY domain, concept, start_seq""")
def group_choice(spark, folder):
    """Best model of a group over each concept, the last window left out."""
    from driftpool.operators import drift, experts
    rows = tables.line_stream(spark, folder).withColumn("model_id", F.concat(F.lit("m"), F.col("concept").cast("string")))
    spans = drift.segments(rows, ["domain"])
    pairs = pool_predictions(spark, folder).withColumnRenamed("model_id", "member")
    out = experts.group_choice(pairs, spans, config.WINDOW, config.WINDOW)
    return out.select("domain", "model_id", big(F.col("start_seq")).alias("start_seq"), "best_id",
                      r(F.col("r2")).alias("r2"), F.col("substitute").cast("int").alias("substitute"))


@query("closest_model", f"""WITH {POOL}, d AS (
  SELECT a.domain, a.model_id, max(abs(a.p - b.p)) AS max_diff FROM pairs a
  JOIN pairs b ON b.domain = a.domain AND b.seq = a.seq AND b.model_id = 'm0' WHERE a.model_id <> 'm0' GROUP BY 1, 2)
SELECT domain, arg_min(model_id, (max_diff, model_id)) AS model_id, round(min(max_diff), 6) AS max_diff FROM d GROUP BY domain""")
def closest_model(spark, folder):
    from driftpool.operators import experts
    out = experts.closest_model(wide_predictions(spark, folder), ["domain"], POOL_IDS, "m0")
    return out.select("domain", "model_id", r(F.col("max_diff")).alias("max_diff"))


def _experts_sql(order):
    """One model joins every 50 rows; a step of the recursion leaves the five to keep and adds the next."""
    decay = f"ln({config.DECAY!r}::DOUBLE)"
    return f"""WITH RECURSIVE {POOL}, e AS (
  SELECT domain, seq, model_id, y, p, abs(p - y) AS e, least((seq - 1) // 50, {POOL_SIZE - 1}) AS k FROM pairs),
per AS (SELECT domain, k, model_id, sum(e) AS spent, coalesce(sum(e) FILTER (WHERE seq = 50 * (k + 1)), 0) AS last FROM e GROUP BY ALL),
live AS (
  SELECT 0::BIGINT AS k, domain, 'm0' AS model_id, 0.0::DOUBLE AS lw, 0::BIGINT AS joined FROM (SELECT DISTINCT domain FROM stream)
  UNION ALL
  SELECT s.k, s.domain, CASE WHEN x = 1 THEN s.next ELSE s.model_id END, CASE WHEN x = 1 THEN ln({config.ADD_WEIGHT!r}::DOUBLE * (s.loss + j.last)) ELSE s.lw END,
         CASE WHEN x = 1 THEN s.k ELSE s.joined END
  FROM (SELECT *, sum(exp(lw) * last) OVER (PARTITION BY domain) AS loss FROM (
    SELECT *, row_number() OVER (PARTITION BY domain ORDER BY {order}) AS place FROM (
      SELECT l.k + 1 AS k, l.domain, l.model_id, l.lw + {decay} * p.spent AS lw, l.joined, p.last, 'm' || (l.k + 1) AS next
      FROM live l JOIN per p ON p.domain = l.domain AND p.k = l.k AND p.model_id = l.model_id WHERE l.k < {POOL_SIZE - 1}))
    WHERE place <= 5) s
  JOIN per j ON j.domain = s.domain AND j.k = s.k - 1 AND j.model_id = s.next, (VALUES (0), (1)) v(x)
  WHERE x = 0 OR s.place = 1),
w AS (
  SELECT e.domain, e.seq, e.y, e.p, l.lw + {decay} * coalesce(sum(e.e) OVER (
    PARTITION BY e.domain, e.k, e.model_id ORDER BY e.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lw
  FROM e JOIN live l ON l.domain = e.domain AND l.k = e.k AND l.model_id = e.model_id),
t AS (SELECT *, exp(lw - max(lw) OVER (PARTITION BY domain, seq)) AS v FROM w),
rows_of AS (SELECT domain, seq, min(y) AS y, sum(v * p) / sum(v) AS p, count(*) AS members FROM t GROUP BY domain, seq)
SELECT domain, count(*) AS n, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 4) + 0.0 AS r2,
       round(avg(abs(y - p)), 4) + 0.0 AS mae, max(members)::INTEGER AS members FROM rows_of GROUP BY domain"""


def _experts(name, evict, order):
    @query(name, _experts_sql(order))
    def run(spark, folder):
        from driftpool.operators import experts
        pairs = pool_predictions(spark, folder)
        place = F.substring("model_id", 2, 5).cast("int")
        joins = pairs.select("domain", "model_id").distinct().select("domain", "model_id", (place * 50 + 1).cast("bigint").alias("at"))
        rows = experts.add_experts(pairs, joins, evict, size=6)
        return rows.groupBy("domain").agg(F.count("*").alias("n"), r(metrics.r2("y", "p"), 4).alias("r2"),
                                          r(metrics.mae("y", "p"), 4).alias("mae"), F.max("members").alias("members"))
    run.__doc__ = f"Decaying experts that join one after another; a full pool drops its {evict}."
    return run


_experts("experts_oldest_out", "oldest", "joined DESC, model_id DESC")
_experts("experts_weakest_out", "weakest", "lw DESC, model_id DESC")


@query("remembered_pool", f"""WITH RECURSIVE {POOL},
mse AS (
  SELECT domain, k, model_id, avg((y - p) ** 2) AS mse FROM pairs, range(0, {POOL_SIZE}) g(k)
  WHERE seq BETWEEN 50 * k - 89 AND 50 * k GROUP BY domain, k, model_id),
live AS (
  SELECT 0::BIGINT AS k, domain, 'm0' AS model_id FROM (SELECT DISTINCT domain FROM stream)
  UNION ALL
  SELECT k, domain, CASE WHEN x = 1 THEN next ELSE model_id END FROM (
    SELECT l.k + 1 AS k, l.domain, l.model_id, n.model_id AS next, n.mse AS new, count(*) OVER (PARTITION BY l.domain) AS size,
           max(q.mse) OVER (PARTITION BY l.domain) AS worst,
           row_number() OVER (PARTITION BY l.domain ORDER BY q.mse DESC, l.model_id) AS place
    FROM live l JOIN mse q ON q.domain = l.domain AND q.k = l.k + 1 AND q.model_id = l.model_id
    JOIN mse n ON n.domain = l.domain AND n.k = l.k + 1 AND n.model_id = 'm' || (l.k + 1)), (VALUES (0), (1)) v(x)
  WHERE (x = 0 AND (size < 4 OR place > 1 OR new >= worst)) OR (x = 1 AND place = 1 AND (size < 4 OR new < worst)))
SELECT domain, model_id, min(k) * 50 + 1 AS start_seq, CASE WHEN max(k) < {POOL_SIZE - 1} THEN max(k) * 50 + 51 END AS end_seq
FROM live GROUP BY domain, model_id""")
def remembered_pool(spark, folder):
    """Ten models join a pool of four one after another; who is turned out stays out."""
    from driftpool.operators import pool
    pairs = pool_predictions(spark, folder)
    joins = staged(pairs.select("domain", "model_id").distinct()).select(
        "domain", "model_id", (F.substring("model_id", 2, 5).cast("int") * 50 + 1).cast("bigint").alias("at"))
    near = pool.recent_rows(pairs, joins, config.WINDOW)
    error = F.col("y") - F.col("p")
    scores = near.groupBy("domain", "at", "model_id").agg(F.avg(error * error).alias("mse"))
    return pool.remembered(staged(scores), joins, 4)
