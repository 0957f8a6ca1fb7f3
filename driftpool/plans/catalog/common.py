"""Shared inputs of the registered queries, once for Spark and once as SQL."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftpool.operators import gram, score
from driftpool.session import join_bounded, staged
from driftpool.sources import tables

WINDOW = 30

# R2 of a group; a constant label gives 1 if predicted exactly, else 0
R2 = """CASE WHEN min(y) < max(y) THEN 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))
  WHEN sum((y - p) * (y - p)) = 0 THEN 1.0 ELSE 0.0 END"""

LINE = """
line AS (
  SELECT l_returnflag || l_linestatus AS domain,
         row_number() OVER (PARTITION BY l_returnflag, l_linestatus
           ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
                    l_extendedprice, l_discount, l_tax) AS seq,
         l_shipdate AS ts, l_suppkey, l_linenumber,
         l_quantity / 50.0 AS x1, l_discount * 10.0 + 0.0 AS x2, l_tax * 12.5 + 0.0 AS x3,
         l_extendedprice / 100000.0 AS x4, (l_partkey % 100) / 100.0 AS x5
  FROM lineitem),
staged AS (SELECT *, CAST(((seq - 1) // 500) % 4 AS INTEGER) AS concept FROM line),
stream AS (
  SELECT *, greatest(0.0, least(1.0, CASE concept
      WHEN 0 THEN (x1 + x2 + x3) / 3
      WHEN 1 THEN (cos(x2) + cos(x3) + cos(x4)) / 3
      WHEN 2 THEN (sin(x1) + sin(x4) + sin(x5)) / 3
      ELSE 1 - (x1 + x2 + x3) / 3 END)) AS y
  FROM staged)"""

# one least-squares model per stream on two features of its first rows
SCORED = LINE + f""",
start AS (
  SELECT domain, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my,
         covar_pop(x1, x1) AS c11, covar_pop(x1, x2) AS c12, covar_pop(x2, x2) AS c22,
         covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2
  FROM stream WHERE seq <= {WINDOW} GROUP BY domain),
fitted AS (
  SELECT domain, (c1 * c22 - c2 * c12) / (c11 * c22 - c12 * c12) AS w1,
         (c2 * c11 - c1 * c12) / (c11 * c22 - c12 * c12) AS w2, m1, m2, my
  FROM start),
scored AS (
  SELECT s.domain, s.seq, s.ts, s.concept, s.y,
         my + w1 * (x1 - m1) + w2 * (x2 - m2) AS p
  FROM stream s JOIN fitted f ON s.domain = f.domain)"""

# events of one user in time order; the event type plays the model in use
USER = """
usr AS (
  SELECT CAST(user_id AS VARCHAR) AS domain,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq,
         ts, event_id, value, event_type AS model_id
  FROM events)"""

# ten one-feature models, fitted per group of suppliers
POOL = LINE + """,
pool AS (
  SELECT 'm' || CAST(l_suppkey % 10 AS VARCHAR) AS model_id,
         regr_slope(y, x1) AS w, regr_intercept(y, x1) AS b, count(*) AS used_for
  FROM stream GROUP BY 1),
pairs AS (
  SELECT s.domain, s.seq, s.y, m.model_id, m.w * s.x1 + m.b AS p
  FROM stream s CROSS JOIN pool m)"""


def r(value: Column, digits: int = 6) -> Column:
    """Rounded, and never minus zero."""
    return F.round(value, digits) + F.lit(0.0)


def big(value: Column) -> Column:
    return value.cast("bigint")


def first_models(stream: DataFrame, window: int = WINDOW) -> DataFrame:
    """One least-squares model per stream on ``x1, x2`` of its first rows."""
    return gram.fit(stream.filter(F.col("seq") <= window), ["domain"], ["x1", "x2"], "y")


def scored_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order-line streams with the prediction of their first model."""
    stream = staged(tables.line_stream(spark, folder))      # ordered once, read for models and rows
    models = first_models(stream).drop("n")
    rows = stream.select("domain", "seq", "ts", "concept", "x1", "x2", "y")
    return join_bounded(rows, models, ["domain"]).select(
        "domain", "seq", "ts", "concept", "y",
        score.linear_columns(["x1", "x2"], F.col("coef"), F.col("intercept")).alias("p"))


def user_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Events of one user in time order, ordered once and read as often as a query needs."""
    return staged(tables.event_rows(spark, folder, "user_id").withColumnRenamed("event_type", "model_id"))


def supplier_models(stream: DataFrame) -> DataFrame:
    """Ten one-feature models, fitted per group of suppliers."""
    return stream.groupBy(F.concat(F.lit("m"), (F.col("l_suppkey") % 10).cast("string")).alias("model_id")).agg(
        F.array(F.regr_slope("y", "x1")).alias("coef"),
        F.regr_intercept("y", "x1").alias("intercept"), F.count("*").alias("used_for"))


def wide_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Every order line with the predictions of all ten models in one array."""
    stream = staged(tables.line_stream(spark, folder))
    rows = stream.select("domain", "seq", "y", "x1", F.array("x1").alias("features"))
    models = supplier_models(stream).withColumn("pool_id", F.lit(0))
    return score.score_wide(rows.withColumn("pool_id", F.lit(0)), models, ["pool_id"]).drop("pool_id")


def pool_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Long form of ``wide_predictions``: one row per order line and model."""
    stream = staged(tables.line_stream(spark, folder))
    models = supplier_models(stream).drop("used_for").withColumn("pool_id", F.lit(0))
    rows = stream.select("domain", "seq", "y", F.array("x1").alias("features")).withColumn("pool_id", F.lit(0))
    return score.score_pool(rows, models, ["pool_id"]).drop("pool_id", "features")
