"""Queries on the similarity of models."""

from pyspark.sql import functions as F

from driftpool.operators import ensemble, gram, similar
from driftpool.plans.catalog import query
from driftpool.plans.catalog.common import LINE, POOL, big, r, wide_predictions
from driftpool.plans.catalog.models import POOL_IDS, POOL_SIZE, SCORES, _scores, three_feature_pool
from driftpool.session import staged
from driftpool.sources import tables

DIMENSIONS = 64

# centroids of the embedding labels stand for models with a vector of predictions
CENTRES = """
c AS (SELECT CAST(label AS VARCHAR) AS model_id, i, avg(CAST(embedding[i] AS DOUBLE)) AS v
      FROM embeddings CROSS JOIN range(1, 65) t(i) GROUP BY 1, 2),
d AS (SELECT a.model_id AS i, b.model_id AS j, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS d
      FROM c a JOIN c b ON a.i = b.i AND a.model_id < b.model_id GROUP BY 1, 2),
near AS (SELECT i AS m, d FROM d UNION ALL SELECT j, d FROM d),
place AS (SELECT m, d, row_number() OVER (PARTITION BY m ORDER BY d) AS k FROM near)"""

SCALED = CENTRES + """,
s AS (SELECT m, d AS scale FROM place WHERE k = {k}),
aff AS (SELECT i, j, d, exp(-d * d / (a.scale * b.scale)) AS affinity FROM d JOIN s a ON a.m = i JOIN s b ON b.m = j)"""


def _centres(spark, folder):
    vectors = tables.table(spark, folder, "embeddings")
    means = [F.avg(F.col("embedding")[i].cast("double")) for i in range(DIMENSIONS)]
    return vectors.groupBy(F.col("label").cast("string").alias("model_id")).agg(
        F.array(*means).alias("vector")).withColumn("pool_id", F.lit(0))


def _distances(spark, folder):
    return similar.vector_pairs(_centres(spark, folder), ["pool_id"])


def _affinities(spark, folder, k):
    return similar.affinities(staged(_distances(spark, folder)), ["pool_id"], k)


@query("standardised", f"""WITH {LINE}, m AS (
  SELECT domain, avg(x1) AS m1, stddev_samp(x1) AS s1, avg(x4) AS m4, stddev_samp(x4) AS s4 FROM line GROUP BY domain)
SELECT l.domain, seq, round((x1 - m1) / s1, 6) + 0.0 AS x1, round((x4 - m4) / s4, 6) + 0.0 AS x4 FROM line l JOIN m ON m.domain = l.domain""")
def standardised(spark, folder):
    rows = tables.line_rows(spark, folder).select("domain", "seq", "x1", "x4")
    out = similar.standardised(rows, ["domain"], ["x1", "x4"])
    return out.select("domain", big(F.col("seq")).alias("seq"), r(F.col("x1")).alias("x1"), r(F.col("x4")).alias("x4"))


@query("vector_distances", f"WITH {CENTRES} SELECT i, j, round(d, 6) AS d FROM d")
def vector_distances(spark, folder):
    return _distances(spark, folder).select("i", "j", r(F.col("d")).alias("d"))


@query("local_scales", f"WITH {CENTRES} SELECT m AS model_id, round(d, 6) AS scale FROM place WHERE k = 7")
def local_scales(spark, folder):
    out = similar.local_scales(_distances(spark, folder), ["pool_id"], 7)
    return out.select("model_id", r(F.col("scale")).alias("scale"))


@query("affinities", f"WITH {SCALED.format(k=7)} SELECT i, j, round(affinity, 6) + 0.0 AS affinity FROM aff")
def affinities(spark, folder):
    return _affinities(spark, folder, 7).select("i", "j", r(F.col("affinity")).alias("affinity"))


@query("affinity_matrix", f"""WITH {SCALED.format(k=3)}, b AS (
  SELECT i, j, affinity FROM aff UNION ALL SELECT j, i, affinity FROM aff UNION ALL SELECT DISTINCT m, m, 1.0 FROM s)
SELECT i, CAST(row_number() OVER (PARTITION BY i ORDER BY j) - 1 AS INTEGER) AS place, round(affinity, 6) + 0.0 AS affinity FROM b""")
def affinity_matrix(spark, folder):
    rows = similar.dense_rows(_affinities(spark, folder, 3), ["pool_id"], "affinity", 1.0)
    return rows.select("i", F.posexplode("row").alias("place", "affinity")).withColumn("affinity", r(F.col("affinity")))


@query("near_duplicates", f"""WITH {SCALED.format(k=3)}
SELECT DISTINCT j AS model_id FROM aff WHERE affinity > 0.25 AND j <> '4'""")
def near_duplicates(spark, folder):
    current = spark.createDataFrame([(0, "4")], "pool_id int, model_id string")
    return similar.near_duplicates(_affinities(spark, folder, 3), ["pool_id"], 0.25, current).select("model_id")


@query("vector_clusters")
def vector_clusters(spark, folder):
    return similar.clusters(_affinities(spark, folder, 3), ["pool_id"]).select("model_id", "cluster")


@query("prediction_distances", f"""WITH {POOL}
SELECT a.domain, a.model_id AS i, b.model_id AS j, round(sqrt(sum((a.p - b.p) * (a.p - b.p))), 4) + 0.0 AS d
FROM pairs a JOIN pairs b ON a.domain = b.domain AND a.seq = b.seq AND a.model_id < b.model_id GROUP BY 1, 2, 3""")
def prediction_distances(spark, folder):
    stats = ensemble.prediction_moments(wide_predictions(spark, folder), ["domain"], POOL_SIZE)
    return similar.prediction_pairs(stats, ["domain"], POOL_IDS).select("domain", "i", "j", r(F.col("d"), 4).alias("d"))


# four features stand for four models' predictions
SHARED = LINE + """,
long AS (SELECT domain, seq, unnest(['x1', 'x2', 'x3', 'y']) AS m, unnest([x1, x2, x3, y]) AS v FROM stream),
ends AS (SELECT domain, m, min(v) AS lo, max(v) AS hi FROM long GROUP BY domain, m),
bins AS (SELECT l.domain, seq, l.m, CASE WHEN hi > lo THEN least(CAST(floor((v - lo) / (hi - lo) * 8) AS INTEGER), 7) ELSE 0 END AS b
         FROM long l JOIN ends e ON e.domain = l.domain AND e.m = l.m),
joint AS (SELECT a.domain, a.m AS i, b.m AS j, a.b AS x, b.b AS z, count(*) AS c
          FROM bins a JOIN bins b ON a.domain = b.domain AND a.seq = b.seq GROUP BY 1, 2, 3, 4, 5),
info AS (SELECT domain, i, j, sum(c / n * ln(c * n / (px * pz))) AS mi FROM (
  SELECT *, sum(c) OVER (PARTITION BY domain, i, j) AS n, sum(c) OVER (PARTITION BY domain, i, j, x) AS px,
         sum(c) OVER (PARTITION BY domain, i, j, z) AS pz FROM joint) GROUP BY domain, i, j),
shared AS (SELECT a.domain, a.i, a.j, a.mi / o.mi AS shared FROM info a JOIN info o ON o.domain = a.domain AND o.i = a.j AND o.j = a.j
           WHERE a.i <> a.j)"""


def _shared(spark, folder):
    names = ["x1", "x2", "x3", "y"]
    wide = tables.line_stream(spark, folder).select("domain", "seq", F.array(*names).alias("preds"))
    return similar.shared_information(wide, ["domain"], names, 8)


@query("shared_information", f"WITH {SHARED} SELECT domain, i, j, round(shared, 6) + 0.0 AS shared FROM shared")
def shared_information(spark, folder):
    return _shared(spark, folder).select("domain", "i", "j", r(F.col("shared")).alias("shared"))


@query("similar_models", f"WITH {SHARED} SELECT domain, i, j FROM shared WHERE shared > 0.003 AND j <> 'x2'")
def similar_models(spark, folder):
    shared = _shared(spark, folder)
    gone = shared.select("domain", F.lit("x2").alias("model_id")).distinct()
    return similar.similar_by_information(shared, 0.003, gone, ["domain"]).select("domain", "i", "j")


@query("best_of_clusters", f"""WITH {SCORES}, k AS (SELECT *, CASE WHEN model_id < 'm5' THEN 0 ELSE 1 END AS cluster FROM scores)
SELECT domain, cluster, max_by(model_id, (r2, model_id)) AS model_id FROM k GROUP BY domain, cluster""")
def best_of_clusters(spark, folder):
    scored = staged(_scores(spark, folder))
    assigned = scored.select("domain", "model_id", F.when(F.col("model_id") < "m5", 0).otherwise(1).alias("cluster"))
    return similar.best_of_clusters(assigned, scored, ["domain"])


@query("cluster_of_model", f"""WITH {SCORES}, k AS (SELECT domain, model_id, CASE WHEN model_id < 'm5' THEN 0 ELSE 1 END AS cluster FROM scores)
SELECT domain, model_id, cluster FROM k WHERE cluster = CASE WHEN domain = 'AF' THEN 0 ELSE 1 END""")
def cluster_of_model(spark, folder):
    scored = staged(_scores(spark, folder))
    assigned = scored.select("domain", "model_id", F.when(F.col("model_id") < "m5", 0).otherwise(1).alias("cluster"))
    target = scored.select("domain").distinct().withColumn("model_id", F.when(F.col("domain") == "AF", "none").otherwise("m7"))
    return similar.cluster_of(assigned, target, ["domain"])


def _directions(spark, folder):
    """Principal directions of every stream's concepts: four models per stream."""
    stream = tables.line_stream(spark, folder)
    named = stream.withColumn("model_id", F.concat(F.lit("c"), F.col("concept").cast("string")))
    return gram.components(named, ["domain", "model_id"], ["x1", "x2", "x3", "x4"], "y", 0.05)


@query("principal_directions")
def principal_directions(spark, folder):
    return _directions(spark, folder).select("domain", "model_id", "n", F.size("pcs").alias("directions"), F.abs(F.col("pcs")[0][0]).alias("first"))


@query("angle_distances")
def angle_distances(spark, folder):
    return similar.angle_pairs(_directions(spark, folder), ["domain"])


@query("angle_distances_of_new")
def angle_distances_of_new(spark, folder):
    models = staged(_directions(spark, folder))
    newest = models.groupBy("domain").agg(F.max("model_id").alias("model_id"))
    return similar.angle_pairs_with(models.join(newest, ["domain", "model_id"], "left_semi"), models, ["domain"])


@query("angle_clusters")
def angle_clusters(spark, folder):
    pairs = staged(similar.angle_pairs(_directions(spark, folder), ["domain"]))
    return similar.clusters(similar.affinities(pairs, ["domain"], 3), ["domain"])


@query("prediction_clusters")
def prediction_clusters(spark, folder):
    stats = ensemble.prediction_moments(three_feature_pool(spark, folder), ["domain"], POOL_SIZE)
    pairs = staged(similar.prediction_pairs(stats, ["domain"], POOL_IDS))
    return similar.clusters(similar.affinities(pairs, ["domain"], 7), ["domain"])
